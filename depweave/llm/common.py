"""Helpers that the operators of this subpackage share."""

# ruff: noqa: F401  (shared_dir and stored are taken from here)

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reach_workers
from ..operators.storage import shared_dir, stored


#: Of texts that go to Python at once, whatever their number of rows.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let workers import the package, and bound what a batch of rows takes there by bytes, as texts may be long."""
    reach_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return a task's memory to the machine, as its Python process stays for the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The names wanted, lengthened until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: list[str]) -> list[Column]:
    return [col(n) for n in names]


def with_file(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a hash of the file that holds each row, under ``name``.

    A row's file stays the same however a scan is split, so it identifies
    the row's home over several scans and retries. Rows that don't come
    straight from files are first written to the shared folder.
    """
    own = cols(docs.columns)
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("the name is taken")
        return docs.select(*own, F.xxhash64(F.col("_metadata.file_path")).alias(name))
    except AnalysisException:
        spread = stored(docs)
        return spread.select(*own, F.xxhash64(F.col("_metadata.file_path")).alias(name))


def file_flags(marks: DataFrame):
    """A UDF over (file, mark): is the pair among the rows of ``marks`` (part, mark)?

    The marks are kept in the shared folder by file, and a task that reads
    a file looks up that file's alone; nothing is broadcast and the rows
    asked about don't move. A file's marks must fit in a task's memory, at
    8 bytes each.
    """
    spark = marks.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark)
    spread = marks.select("part", "mark").withColumn("bucket", F.pmod("part", F.lit(width)))
    spread.repartition(width, "bucket").sortWithinPartitions("bucket", "part").write.partitionBy("bucket").parquet(path)
    uri = path if "://" in path else f"file://{path}"

    def marks_of(one: int) -> np.ndarray:
        fs, root = pa.fs.FileSystem.from_uri(uri)
        folder = f"{root}/bucket={one % width}"
        if fs.get_file_info(folder).type == pa.fs.FileType.NotFound:
            return np.zeros(0, np.int64)
        found = pq.read_table(folder, columns=["mark"], filesystem=fs, filters=[("part", "=", one)], partitioning=None)
        return np.unique(found.column("mark").to_numpy())

    @F.pandas_udf("boolean")
    def flagged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        at, known = None, np.zeros(0, np.int64)
        for parts, marks in batches:
            out = np.zeros(len(parts), bool)
            has = marks.notna().to_numpy()
            value, p = marks.fillna(0).to_numpy().astype(np.int64), parts.to_numpy()
            for one in np.unique(p):
                if one != at:
                    at, known = one, marks_of(int(one))
                if len(known):
                    here = (p == one) & has
                    place = np.minimum(np.searchsorted(known, value[here]), len(known) - 1)
                    out[here] = known[place] == value[here]
            yield pd.Series(out)

    return flagged
