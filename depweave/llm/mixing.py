"""Mixing sources to target weights by repeating or thinning documents."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cols, fresh, load, stored

SEED = 20240
#: What the query multiplies the default weights of some sources by: one is repeated, one thinned.
EMPHASIS = {"src1": 3.0, "src2": 2.0, "src3": 0.25}


def _weight(source, default, values: Mapping[str | None, float]):
    """``values`` by source, checked; ``default`` for the rest."""
    out = default
    for name, value in values.items():
        if not (math.isfinite(value) and value >= 0):
            raise ValueError(f"the weight of source {name!r} is {value}; weights are finite and not negative")
        out = F.when(source.eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, seed: int = SEED, copy_column: str | None = None, emphasis: Mapping[str | None, float] | None = None) -> DataFrame:
    """Each document as many times as its source's repetition rate asks.

    Tokens (runs without white space) are summed per source over all
    documents. A source's rate is ``weight * all tokens / its tokens`` with
    weights normalised to 1 over the sources that have tokens; without
    ``weights`` a source weighs the square root of its tokens, which lifts
    small sources over large ones. ``emphasis`` multiplies the weights of
    the sources it names. A document appears ``floor(rate)`` times, and once
    more if a uniform draw hashed from the seed and its ``doc_id`` is below
    the fraction, so a second run gives the same copies.

    Defined results: a null source is a source of its own (``None`` in
    ``weights``); sources missing from ``weights`` or of weight 0 are left
    out, with or without tokens; a source of some weight but without any
    token keeps each document once; weights that no source with tokens has
    (none at all, say) leave no document with a token; a weight that is
    negative or not finite is a ValueError; null or empty texts have no
    tokens; without ``doc_id`` the draw is hashed from the text; repeated
    rows draw alike; extra columns pass through. ``copy_column`` numbers the
    copies from 0. An empty table gives an empty one.
    """
    names = docs.columns
    n, w, total, whole, rate, copy = fresh(docs, "tokens", "weight", "total", "whole", "rate", copy_column or "copy")
    source = fresh(docs, "mixed_source")[0]
    counted = docs.select(col("source").alias(source), F.coalesce(F.regexp_count(col("text"), F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long").alias(n))
    per = stored(counted.groupBy(source).agg(F.sum(n).alias(n)))
    weight = _weight(F.col(source), F.greatest(F.sqrt(F.col(n).cast("double")), F.lit(1.0)), {}) if weights is None else _weight(F.col(source), F.lit(0.0), weights)
    per = per.withColumn(w, weight * _weight(F.col(source), F.lit(1.0), emphasis or {}))
    sums = per.where(F.col(n) > 0).agg(F.sum(n).alias(total), F.sum(w).alias(whole))
    rates = stored(
        per.crossJoin(F.broadcast(sums)).select(  # one row
            source,
            F.when(F.col(w) == 0, F.lit(0.0)).when(F.col(n) == 0, F.lit(1.0)).otherwise(F.col(w) / F.col(whole) * F.col(total) / F.col(n)).alias(rate),
        )
    )
    key = F.coalesce(col("doc_id").cast("string"), F.md5(col("text")), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    times = F.floor(rate) + F.when(draw < F.col(rate) - F.floor(rate), 1).otherwise(0)
    out = docs.join(rates, col("source").eqNullSafe(F.col(source)), "inner")
    unit = fresh(docs, "unit")[0]
    out = out.select(*cols(names), F.posexplode(F.array_repeat(F.lit(True), times.cast("int"))).alias(copy, unit))
    return out.select(*cols(names), *([F.col(copy).cast("long").alias(copy)] if copy_column else []))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), copy_column="copy", emphasis=EMPHASIS)


MIX_SQL = """
WITH counted AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens FROM {docs}
), per AS (
  SELECT source, sum(tokens)::BIGINT AS n, greatest(sqrt(sum(tokens)::DOUBLE), 1.0) * CASE source {emphasis} ELSE 1.0 END AS w FROM counted GROUP BY source
), sums AS (SELECT sum(n)::BIGINT AS total, sum(w) AS whole FROM per WHERE n > 0), rates AS (
  SELECT source, CASE WHEN w = 0 THEN 0.0 WHEN n = 0 THEN 1.0 ELSE w / whole * total / n END AS rate FROM per, sums
), timed AS (
  SELECT d.*, floor(rate)::BIGINT + CASE WHEN
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '') || ':{seed}'), 1, 8))::BIGINT / 4294967296.0
    < rate - floor(rate) THEN 1 ELSE 0 END AS times
  FROM {docs} d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, text, lang, source, n_chars{copy} FROM (SELECT *, unnest(range(times)) AS copy FROM timed)
"""

QUERIES = {"op7_source_mixing": op7_source_mixing}
ORACLES = {"op7_source_mixing": MIX_SQL.format(docs="documents", seed=SEED, copy=", copy", emphasis=" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in EMPHASIS.items()))}
