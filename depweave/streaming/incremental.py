"""A parse cache that follows a stream of file listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.cache import split_by_cache, updated_cache
from ..operators.storage import scratch, stored
from ..schema import CACHE
from ..sources.graph_files import read_cache, write_cache


def newest(listing: DataFrame) -> DataFrame:
    """Of each path the row that was changed last."""
    last = Window.partitionBy("path").orderBy(F.desc("mtime_ms"), F.desc("size"))
    return listing.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def apply_listing(cache: DataFrame, listing: DataFrame, parse: Callable[[DataFrame], DataFrame], whole: bool = False) -> DataFrame:
    """The cache after a listing (path, size, mtime_ms): changed files parsed, others as they were.

    A ``whole`` listing names all files, so what it lacks is dropped; else it
    names what may have changed, and a row without a size a file that went.
    """
    now = stored(newest(listing))
    missed = split_by_cache(now.where("size is not null"), cache).where("status = 'miss'").drop("status")
    fresh = stored(parse(missed))
    if not whole:
        rest = cache.select("path", "mtime_ms", "size").join(now.select("path"), "path", "left_anti")
        now = now.where("size is not null").select("path", "mtime_ms", "size").unionByName(rest)
    return updated_cache(cache, now, fresh)


def follow(listings: DataFrame, path: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Keep the cache at ``path`` up to date with a stream of changed files.

    A batch that is run again finds its files in the cache and parses
    nothing, so the result is the same.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        cache = read_cache(spark, path)
        if cache is None:
            cache = spark.createDataFrame([], CACHE)
        with scratch(spark):
            write_cache(apply_listing(cache, batch, parse), path)

    return listings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
