"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many links of a graph are followed on the driver at once rather than in rounds of jobs; the results are the same.
DRIVER_LINKS = 200_000
#: Rows of a table, with a text or two, that a join may send to all tasks; a row takes some 200 bytes there.
SENT = 500_000
#: Folders made and not yet deleted, those of the innermost scratch last.
_made: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only where the session has no such setting and runs on one machine, as
    in tests, is a temporary folder taken, which goes when the driver ends.
    What is made within :func:`scratch` goes with it, the rest by
    :func:`release`.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="depweave-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{local}")
        root = spark.sparkContext.getCheckpointDir()
    _made[-1].append(f"{root.rstrip('/')}/depweave-{uuid.uuid4().hex}")
    return _made[-1][-1]


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders, on whatever file system they are."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within goes at its end, so results must have been written by then."""
    _made.append([])
    try:
        yield
    finally:
        delete(spark, *_made.pop())


def release(spark: SparkSession) -> None:
    """Delete all that was stored outside of a scratch; DataFrames made from it can't be read any more."""
    delete(spark, *_made[0])
    _made[0].clear()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    It cuts the lineage at a place that outlives executors, and gives the
    planner true sizes for its choice between broadcast and shuffle.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = SENT) -> DataFrame:
    """A stored table for a join that sends it to all tasks, so that the other side stays where it is, if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else unsent(df)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that doesn't send it to the driver and from there to all tasks.

    The planner goes by the size in files, where numbered ids take little,
    and unfolds to texts of fifty times that.
    """
    return df.hint("merge")


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """``df`` with numbers from 0 on in the order of columns, without a task that sees all rows.

    Rows are sorted in ranges; a range goes on from the sizes of those
    before it, of which there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(width, *order).withColumn("range_", F.spark_partition_id()))
    before, seen = [(-1, 0)], 0
    for r in sorted(ranged.groupBy("range_").count().collect()):
        before.append((r.range_, seen))
        seen += r["count"]
    offset = F.broadcast(spark.createDataFrame(before, "range_ int, seen_ long"))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranged.join(offset, "range_").withColumn(name, F.col("seen_") + place).drop("range_", "seen_")


def pairs_if_few(links: DataFrame, enough: int) -> list[tuple] | None:
    """The rows of a stored table of two columns, None if there are more than ``enough``."""
    if links.count() > enough:
        return None
    held = links.toPandas()
    return list(zip(held.iloc[:, 0], held.iloc[:, 1]))
