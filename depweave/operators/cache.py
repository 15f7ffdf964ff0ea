"""Re-extraction of changed files only, by their fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1


def split_by_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` (path, size, mtime_ms) with ``status``: ``hit`` if time and size are the cache's and it holds a record, else ``miss``.

    A file of unknown size or time, as one that vanished, is a miss.
    """
    old = cache.select(F.col("path").alias("c_path"), F.col("mtime_ms").alias("c_mtime"), F.col("size").alias("c_size"), F.col("data").isNotNull().alias("c_has"))
    same = F.coalesce((F.col("mtime_ms") == F.col("c_mtime")) & (F.col("size") == F.col("c_size")) & F.col("c_has"), F.lit(False))
    return files.join(old, F.col("path") == F.col("c_path"), "left").withColumn("status", F.when(same, "hit").otherwise("miss")).drop("c_path", "c_mtime", "c_size", "c_has")


def stale_paths(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path) of cached files that are no longer there."""
    return cache.select("path").join(files.select("path"), "path", "left_anti")


def updated_cache(cache: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache without stale paths, with ``fresh`` records (id, ...) under the sizes and times of ``files`` now.

    A record whose file has vanished since goes. Failed records are kept, so
    that a file is tried again only once it has changed.
    """
    fields = [c for c in cache.schema["data"].dataType.names]
    now = files.select("path", "mtime_ms", "size").where("mtime_ms is not null and size is not null")
    new = fresh.where("id is not null").select(F.col("id").alias("path"), F.struct(*fields).alias("data")).join(now, "path").select("path", "mtime_ms", "size", "data")
    gone = fresh.select(F.col("id").alias("path"))
    kept = cache.join(files.select("path"), "path", "left_semi").join(gone, "path", "left_anti").select("path", "mtime_ms", "size", "data")
    return kept.unionByName(new)
