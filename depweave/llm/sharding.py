"""Sharding along a Hilbert curve for pruning in several dimensions."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import col, cols, fresh, load, stored

DIMENSIONS = ("n_chars", "source", "lang")
CELL_BITS = 10
SHARD_CHARS, MOST_SHARDS = 64 << 20, 1 << 16
#: Rows of the table of cells that is sent to all executors.
MOST_CELLS = 1 << 20


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below ``2**bits``.

    Skilling's transposition: undo the excess work from the high bit down,
    Gray-encode, then interleave the bits of the dimensions.
    """
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(n):
            high = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if d:
                x[d] = np.where(high, x[d], x[d] ^ swap)
        q >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << 1) | (((x[d] ^ t) >> b) & 1)
    return out


def _number(df: DataFrame, name: str) -> Column:
    """A dimension that isn't text as an order-preserving number."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    return col(name).cast("double")


def text_cuts(values: DataFrame, cells: int) -> list[str]:
    """The first values of ``cells`` equal shares of the rows of ``values`` (v string), but for the first share.

    Whole values count, over all rows: different ones are counted, put in
    order over several tasks, and each task's running sum goes on from the
    sums of those before it. A value belongs to the share in which its first
    row lies; shares in which no value begins have none.
    """
    spark = values.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = values.where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ordered = stored(counted.repartitionByRange(width, "v").select("v", "n", F.spark_partition_id().alias("part")))
    sums = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each task
    total = sum(n for _, n in sums)
    if not total:
        return []
    before, seen = [], 0
    for part, n in sums:
        before.append((part, seen))
        seen += n
    offset = F.broadcast(spark.createDataFrame(before, "part int, seen long"))
    walk = Window.partitionBy("part").orderBy("v")
    behind = F.coalesce(F.sum("n").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.withColumn("behind", behind).join(offset, "part")
    placed = placed.select("part", "v", F.floor((F.col("seen") + F.col("behind")).cast("decimal(28,0)") * cells / total).cast("int").alias("cell"))
    heads = placed.withColumn("last", F.lag("cell").over(walk)).where("last is null or last <> cell").select("v", "cell").collect()  # at most one for each cell and task
    out, at = [], 0
    for r in sorted(heads):
        if r.cell > at:
            out.append(r.v)
            at = r.cell
    return out


def hilbert_shards(
    docs: DataFrame,
    dimensions: Sequence[str] = DIMENSIONS,
    bits: int = CELL_BITS,
    shard_chars: int = SHARD_CHARS,
    size: str = "n_chars",
    index_column: str = "curve_index",
    shard_column: str = "shard_id",
    most_shards: int = MOST_SHARDS,
) -> DataFrame:
    """``docs`` in runs along a Hilbert curve, one partition to a shard.

    Each dimension is quantised to ``2**bits`` cells of about equal numbers
    of rows, texts by their whole values. Cells are walked along the curve
    and cut into runs of ``shard_chars``, or of more if there were over
    ``most_shards``. If more than MOST_CELLS are occupied, the curve's last
    steps are left out until there are fewer, as its beginnings are a coarser
    curve; so only a table of bounded size is sent to all executors. A cell
    of more than an eighth of a run is spread over its length of the walk by
    a hash of the row, so no run is much longer than asked. Row group
    statistics of the written files then prune on any dimension.

    Defined results: nulls lie in the first cell of a dimension; a missing or
    negative size counts as 0; ties of all dimensions share a cell; repeated
    rows go to the same shard. The two columns made replace columns of the
    same name; other columns pass through. An empty table gives an empty one.
    """
    if bits * len(dimensions) > 62:
        raise ValueError("bits times dimensions must be at most 62")
    own = [n for n in docs.columns if n.lower() not in (index_column.lower(), shard_column.lower())]
    docs = docs.select(*cols(own))
    amount, start = fresh(docs, "cell_amount", "cell_start")
    is_text = [isinstance(docs.schema[d].dataType, (T.StringType, T.BinaryType)) for d in dimensions]
    values = [col(d).cast("string") if text else _number(docs, d) for d, text in zip(dimensions, is_text)]
    ranks = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [F.percentile_approx(x, ranks, 10000).alias(f"c{i}") for i, (x, text) in enumerate(zip(values, is_text)) if not text]
    found = docs.agg(*numbers).first().asDict() if numbers else {}
    cuts = [text_cuts(docs.select(x.alias("v")), 1 << bits) if text else np.unique(np.array(found[f"c{i}"] or [], float)) for i, (x, text) in enumerate(zip(values, is_text))]

    def cell(s: pd.Series, c) -> np.ndarray:
        if isinstance(c, list):
            code, each = pd.factorize(s)
            return np.append([bisect_right(c, v) for v in each], 0)[code]  # -1, the last, is null
        return np.where(s.isna(), 0, np.searchsorted(c, s.to_numpy(float, na_value=-np.inf), side="right"))

    @F.pandas_udf("long")
    def place(*dims: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([cell(s, c) for s, c in zip(dims, cuts)], 1), bits))

    weight = F.greatest(F.coalesce(col(size).cast("long"), F.lit(0)), F.lit(0))
    indexed = docs.withColumn(index_column, place(*values))
    per_cell = stored(indexed.groupBy(index_column).agg(F.sum(weight).alias(amount)))
    total = per_cell.agg(F.sum(amount)).first()[0] or 0
    shard_chars = max(shard_chars, -(-total // most_shards))
    shift = 0
    coarse = lambda: F.shiftright(F.col(index_column), shift)
    while per_cell.select(coarse()).distinct().count() > MOST_CELLS:
        shift += len(dimensions)
    per_cell = per_cell.groupBy(coarse().alias(index_column)).agg(F.sum(amount).alias(amount))
    walk = Window.orderBy(index_column).rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_CELLS rows
    cells = stored(per_cell.select(F.col(index_column), F.col(amount), F.coalesce(F.sum(amount).over(walk), F.lit(0)).alias(start)))
    share = F.pmod(F.xxhash64(*cols([n for n in ("doc_id", size) if n in own])), F.lit(1 << 20)) / float(1 << 20)
    spread = F.when(F.col(amount) * 8 > shard_chars, share * F.col(amount)).otherwise(0.0)
    sharded = indexed.withColumn(index_column, coarse()).join(F.broadcast(cells), index_column)
    sharded = sharded.withColumn(shard_column, F.floor((F.col(start) + spread) / shard_chars).cast("int"))
    inside = [index_column] + [n for n in ("doc_id",) if n in own]
    return sharded.repartitionById(total // shard_chars + 1, F.col(shard_column)).sortWithinPartitions(*inside).select(*cols(own), index_column, shard_column)


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(load(spark, sf_dir, "documents"))


QUERIES = {"op4_hilbert_sharding": op4_hilbert_sharding}
ORACLES: dict[str, str] = {}
