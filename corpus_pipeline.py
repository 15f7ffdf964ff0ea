"""A training corpus from documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import exact_dedup, language_id, mixing, near_dedup, tokenization
from depweave.llm.common import fresh, prepare
from depweave.operators.storage import delete, scratch, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no known language is found go; the others have the one found as ``lang``."""
    prepare(spark)
    found, taken = fresh(docs, "found_language", "found_accepted")
    told = language_id.identify(docs, language=found, accepted=taken).where(F.col(taken))
    return told.select("doc_id", "text", F.col(found).alias("lang"), "source", "n_chars")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    prepare(spark)
    return exact_dedup.exact_dedup(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    prepare(spark)
    return near_dedup.near_dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned until sources weigh the square root of their tokens, some more or less by EMPHASIS."""
    prepare(spark)
    return mixing.mix(docs, emphasis=mixing.EMPHASIS).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, checked against the text they decode to."""
    prepare(spark)
    return tokenization.encode(docs).select("doc_id", "lang", "source", "ids", "n_ids", "lossless")


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: Language models of kernels, signatures and ids of pieces are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of ``sf_dir``."""
    prepare(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        delete(spark, *before)  # what the stage before left is read no more
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
