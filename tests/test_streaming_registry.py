import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from depweave.plans import registry
from depweave.sources.graph_files import read_cache
from depweave.streaming.incremental import follow

SF = "/root/testdata/sf0.001"
LISTING = "path string, size long, mtime_ms double"


def test_cache_follows_a_stream(spark, tmp_path):
    asked = []

    def parse(files):
        asked.append(sorted(r.path for r in files.collect()))
        empty = F.array().cast("array<string>")
        parts = F.struct(*(empty.alias(n) for n in ("classes", "functions", "methods", "docstrings", "flat")))
        return files.select(F.col("path").alias("id"), F.array(F.col("size").cast("string")).alias("dependencies"), parts.alias("entities"), F.lit(False).alias("error"))

    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")

    def step(rows):
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LISTING).parquet(source)
        follow(stream, cache, str(tmp_path / "ck"), parse).awaitTermination(60)
        return {r.path: r.data.dependencies[0] for r in read_cache(spark, cache).collect()}

    assert step([("/a", 1, 1.0), ("/b", 2, 1.0), ("/a", 3, 2.0)]) == {"/a": "3", "/b": "2"}
    assert step([("/a", 3, 2.0), ("/b", None, None), ("/c", 4, 1.0)]) == {"/a": "3", "/c": "4"}
    assert asked == [["/a", "/b"], ["/c"]]


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["id", "dependencies"] and got.count() == 5


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, oracle, name):
    names, rows = oracle(registry.ORACLES[name], SF)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    ours = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=repr)
    assert ours == sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).collect() is not None
