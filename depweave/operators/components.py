"""Connected components, and work on them in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .storage import DRIVER_LINKS, pairs_if_few, stored, unsent


def components(edges: DataFrame, enough: int = DRIVER_LINKS) -> DataFrame:
    """(node, least) for the nodes of ``edges`` (a, b) but the least ones: the least node each is connected to.

    Large stars and small stars alternate until nothing changes; every round
    is written to the shared folder. No more than ``enough`` links are
    joined on the driver instead.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if (few := pairs_if_few(links, enough)) is not None:
        kind = links.schema["u"].dataType.simpleString()
        return edges.sparkSession.createDataFrame(sorted(_joined(few).items()), f"node {kind}, least {kind}")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = _starred(large.where("u <> v").distinct())
        pair = lambda a: F.struct(F.col(a).alias("u"), F.col("m").alias("v"))
        links = stored(small.select(F.explode(F.array(pair("v"), pair("u"))).alias("e")).select("e.*").where("u <> v").distinct())
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
        before = now


def by_component(links: DataFrame, work: Callable[[list[tuple]], Iterable[tuple]], schema: str, enough: int = DRIVER_LINKS, split: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(rows, rest): what ``work`` gives for the rows of ``links``, whose first two columns are their ends.

    A task is given all links of several connected components, some
    ``enough`` links at a time, so nothing of them comes to the driver.
    Links of components that have more than ``enough`` are the rest, if
    there are any; without ``split`` such a component has a task as well.
    """
    spark, columns = links.sparkSession, links.columns
    a, b = columns[:2]
    links = stored(links)
    parts = components(links.select(F.col(a).alias("a"), F.col(b).alias("b"))).select(F.col("node").alias(a), "least")
    links = stored(links.join(unsent(parts), a, "left").select(*columns, F.coalesce("least", a).alias("part_")))
    rest = None
    if split:
        large = stored(links.groupBy("part_").count().where(F.col("count") > enough).select("part_"))
        if not large.isEmpty():
            rest = links.join(large, "part_", "left_semi").select(*columns)
            links = links.join(large, "part_", "left_anti")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // max(1, enough)))
    held_as = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if held and (out := list(work(held))):
            yield pa.RecordBatch.from_pylist([dict(zip(held_as.names, row)) for row in out], held_as)

    return stored(links.repartition(tasks, "part_").select(*columns).mapInArrow(run, schema)), rest


def _joined(links: list[tuple]) -> dict:
    """The least node that each of the links' other nodes is connected to."""
    above: dict = {}

    def top(n):
        while (up := above.setdefault(n, n)) != n:
            above[n] = above[up]
            n = up
        return n

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {n: least for n in list(above) if (least := top(n)) != n}


def _starred(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with the least v of each u as m: by a join, which unlike a window may split the links of a hub."""
    return links.join(unsent(links.groupBy("u").agg(F.min("v").alias("m"))), "u")
