"""Exact deduplication by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cols, fresh, load, shared_dir, stored, with_file

#: Bits of a fingerprint. Two different texts of a trillion meet with odds of
#: 1 in 280; such pairs cost a needless shuffle of two rows, never a result.
BITS = 48
#: Fingerprints that one owner takes at most on average, some 100 MB while it looks for equal ones.
OWNER_MARKS = 2 << 20


def golomb_encode(values: np.ndarray, span: float) -> tuple[int, bytes]:
    """Sorted unsigned integers of a range ``span`` wide as (k, Rice code).

    The gaps are split at ``2**k``, the power of two nearest to the mean gap
    times ln 2. Quotients are in unary and stand before the fixed-width
    remainders, so that both can be coded and decoded without a loop.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return 0, b""
    k = max(0, min(62, round(math.log2(max(1.0, span / n * math.log(2))))))
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    """The ``n`` sorted integers of which :func:`golomb_encode` made ``code``."""
    if not n:
        return np.zeros(0, np.uint64)
    held = np.frombuffer(code, np.uint8)
    tail = (n * k + 7) // 8
    unary = np.unpackbits(held[: len(held) - tail])
    ends = np.flatnonzero(unary == 0)[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        rest = np.unpackbits(held[len(held) - tail :])[: n * k].reshape(n, k)
        low = np.zeros(n, np.uint64)
        for j in range(k):
            low = (low << np.uint64(1)) | rest[:, j]
        gaps = (gaps << np.uint64(k)) | low
    return np.cumsum(gaps, dtype=np.uint64)


def _encode(owner_bits: int, bits: int):
    low = np.uint64(bits - owner_bits)
    span = float(1 << (bits - owner_bits))
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("owner", pa.int32()), ("n", pa.int64()), ("k", pa.int32()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            part, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
            for p in np.unique(part):
                held.setdefault(int(p), []).append(mark[part == p])
        rows = []
        chunk = TaskContext.get().partitionId()
        for p, lists in held.items():
            marks = np.sort(np.concatenate(lists))
            owners = (marks >> low).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owners, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(marks)]):
                k, code = golomb_encode(marks[a:b] & np.uint64((1 << int(low)) - 1), span)
                rows.append((p, chunk, int(owners[a]), int(b - a), k, code))
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096]), schema)], schema=schema)

    return run


def _own(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What an owner answers: for each list it got, a bitmap of the hashes that it has seen more than once."""
    lists = [golomb_decode(n, k, c) for n, k, c in zip(rows.n, rows.k, rows.code)]
    values, where, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice = (times > 1)[where]
    maps = np.split(twice, np.cumsum([len(x) for x in lists])[:-1])
    any_set = [bool(m.any()) for m in maps]
    out = rows.loc[any_set, ["part", "chunk", "owner"]].copy()
    out["bitmap"] = [np.packbits(m).tobytes() for m, s in zip(maps, any_set) if s]
    return out


def _suspects(owner_bits: int, bits: int):
    low = bits - owner_bits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for part, owner, n, k, code, bitmap in zip(rows.part, rows.owner, rows.n, rows.k, rows.code, rows.bitmap):
                marks = np.unique(golomb_decode(n, k, code)[np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)])
                k2, code2 = golomb_encode(marks, float(1 << low))
                out.append((part, owner, len(marks), k2, code2))
            yield pd.DataFrame(out, columns=["part", "owner", "n", "k", "code"])

    return run


def duplicate_flags(marked: DataFrame, part: str, mark: str, bits: int):
    """A UDF over (part, mark): may the row have a copy?

    ``marked`` has a row's file and fingerprint. Partitions send their
    sorted, compressed fingerprints to the owners of hash ranges and get
    bitmaps back; what a bitmap marks is kept per file in the shared folder,
    where the tasks that read the file look it up. About ``bits`` minus the
    log of a partition's rows, plus 1.5, is what a document costs on the way
    out, and one bit on the way back.
    """
    spark = marked.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = max(2, width, marked.count() / OWNER_MARKS)  # rows are counted in the files' footers
    owner_bits = min(bits - 4, max(4, math.ceil(math.log2(needed))))
    codes = stored(marked.where(F.col(mark).isNotNull()).select(part, mark).mapInArrow(_encode(owner_bits, bits), "part long, chunk long, owner int, n long, k int, code binary"))
    maps = codes.groupBy("owner").applyInPandas(_own, "part long, chunk long, owner int, bitmap binary")
    lists = codes.join(maps, ["part", "chunk", "owner"]).mapInPandas(_suspects(owner_bits, bits), "part long, owner int, n long, k int, code binary")
    path = shared_dir(spark)
    lists.withColumn("bucket", F.pmod("part", F.lit(width))).repartition(width, "bucket").sortWithinPartitions("bucket", "part").write.partitionBy("bucket").parquet(path)
    uri = path if "://" in path else f"file://{path}"
    shift = bits - owner_bits

    def suspects_of(one: int) -> np.ndarray:
        fs, root = pa.fs.FileSystem.from_uri(uri)
        folder = f"{root}/bucket={one % width}"
        if fs.get_file_info(folder).type == pa.fs.FileType.NotFound:
            return np.zeros(0, np.uint64)
        rows = pq.read_table(folder, filesystem=fs, filters=[("part", "=", one)], partitioning=None).to_pylist()
        lists = [golomb_decode(r["n"], r["k"], r["code"]) | np.uint64(r["owner"] << shift) for r in rows]
        return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)

    @F.pandas_udf("boolean")
    def flagged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        at, known = None, np.zeros(0, np.uint64)
        for parts, marks in batches:
            out = np.zeros(len(parts), bool)
            has = marks.notna().to_numpy()
            value = marks.fillna(0).to_numpy().astype(np.int64).astype(np.uint64)
            p = parts.to_numpy()
            for one in np.unique(p):
                if one != at:
                    at, known = one, suspects_of(int(one))
                if len(known):
                    here = (p == one) & has
                    place = np.minimum(np.searchsorted(known, value[here]), len(known) - 1)
                    out[here] = known[place] == value[here]
            yield pd.Series(out)

    return flagged


def exact_dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One document of each group whose texts are the same bytes.

    The smallest ``doc_id`` stays (a null one only if the group has no
    other); of rows that share it, the one first by its JSON. Fingerprints
    only choose who is compared; the texts themselves decide.

    Defined results: a null text says nothing and stays; empty texts are
    copies of each other; repeated rows are copies; columns other than
    ``text`` and ``doc_id`` don't matter and pass through, whatever their
    names. An empty table gives an empty one.
    """
    names = docs.columns
    part, mark, keep, order, flag = fresh(docs, "dedup_part", "dedup_mark", "dedup_keep", "dedup_order", "dedup_flag")
    homed = with_file(docs, part).withColumn(mark, F.when(col("text").isNotNull(), F.shiftrightunsigned(F.xxhash64(col("text")), 64 - bits)))
    flagged = duplicate_flags(homed, part, mark, bits)
    marked = homed.withColumn(flag, flagged(F.col(part), F.col(mark)))
    alone = marked.where(~F.col(flag)).select(*cols(names))
    rest = [n for n in names if n not in ("text", "doc_id")]
    suspects = marked.where(F.col(flag)).select(mark, *cols(names))
    kept = suspects.groupBy(mark, col("text")).agg(
        F.min_by(
            F.struct(*cols(names)),
            F.struct(col("doc_id").isNull(), col("doc_id"), F.to_json(F.struct(*cols(rest))) if rest else F.lit("")),
        ).alias(keep)
    )
    return alone.unionByName(kept.select(*(F.col(keep).getField(n).alias(n) for n in names)))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


EXACT_SQL = """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS place FROM {docs}
) WHERE place = 1 OR text IS NULL
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {"op1_exact_dedup": EXACT_SQL.format(docs="documents")}
