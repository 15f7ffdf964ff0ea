"""Queries over the supply graph, whose entities are as many as suppliers times customers."""

import duckdb
import pytest

from pyspark.sql import functions as F

from depweave.functions import columns
from depweave.operators import cluster, enrich, ui
from depweave.plans import registry
from depweave.sources import adapters

SUPPLIERS, CUSTOMERS = 60, 300
#: Rows of all tables together are fewer, entities many more.
FEW = 3000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """One nation, so that every customer is an entity of every supplier."""
    path = tmp_path_factory.mktemp("supply")
    con = duckdb.connect()
    for name, sql in {
        "region": "SELECT 0 AS r_regionkey, 'ASIA' AS r_name",
        "nation": "SELECT 0 AS n_nationkey, 'INDIA' AS n_name, 0 AS n_regionkey",
        "supplier": f"SELECT i AS s_suppkey, 'Supplier#' || i AS s_name, 0 AS s_nationkey FROM range({SUPPLIERS}) t(i)",
        "customer": f"SELECT i AS c_custkey, 'Customer#' || i AS c_name, 0 AS c_nationkey, ['BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE'][i % 4 + 1] AS c_mktsegment FROM range({CUSTOMERS}) t(i)",
        "part": "SELECT i AS p_partkey, 'part ' || i AS p_name, (i % 50)::INT AS p_size FROM range(80) t(i)",
        "lineitem": f"SELECT i AS l_orderkey, i * 7 % 80 AS l_partkey, i * 3 % {SUPPLIERS // 2} AS l_suppkey, 1::INT AS l_linenumber, 1.0::DOUBLE AS l_quantity FROM range(400) t(i)",
    }.items():
        con.execute(f"COPY ({sql}) TO '{path}/{name}.parquet'")
    return str(path)


def nodes_of(plan):
    yield plan
    for inner in ("executedPlan", "plan"):  # of an adaptive plan, of a stage of it
        if plan.nodeName().startswith({"executedPlan": "AdaptiveSparkPlan", "plan": ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage", "ResultQueryStage")}[inner]):
            yield from nodes_of(getattr(plan, inner)())
    children = plan.children()
    for i in range(children.size()):
        yield from nodes_of(children.apply(i))


def most(df, metric):
    """The greatest figure of a kind at any node of the plan that ran."""
    found = [0]
    for node in nodes_of(df._jdf.queryExecution().executedPlan()):
        held = node.metrics().get(metric)
        if held.isDefined():
            found.append(held.get().value())
    return max(found)


def matches(got, sql, oracle, folder):
    names, rows = oracle(sql, folder)
    key = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    return key(map(tuple, got.select(*names).collect())) == key(rows)




@pytest.mark.parametrize("name", ["cluster_payload", "dependencies_of", "entity_parents", "health_ratios", "language_breakdown", "largest_files", "target_stats", "ui_connected", "node_composition", "ui_communities", "edge_composition"])
def test_entities_are_counted_without_being_formed(spark, oracle, folder, name):
    got = registry.QUERIES[name](spark, folder)
    assert matches(got, registry.ORACLES[name], oracle, folder)
    got.collect()
    assert 0 < most(got, "numOutputRows") < FEW < SUPPLIERS * CUSTOMERS


def test_payload_sizes(graph, spark):
    nodes, edges = graph(
        [("/a", "F", {"docstrings": ["d", "e"]}), ("/b", "F"), ("/a::C", "class"), ("/a::f", "function"), ("/a::m", "method"), ("/a::e", "entity"), ("x", "X")],
        [("/a", "=/a::C"), ("/a", "=/a::f"), ("/a", "=/a::m"), ("/a", "=/a::e"), ("/a", "x"), ("/a", "x"), ("/a", "/b")],
    )
    told = {r.file: (len(r.ast_classes), len(r.ast_functions), len(r.ast_docstrings), len(r.graph_edges_to)) for r in cluster.payloads(nodes, edges).collect()}
    assert told == {r.file: tuple(r)[1:] for r in cluster.payload_sizes(nodes, edges).collect()} == {"/a": (1, 2, 2, 2), "/b": (0, 0, 0, 0)}
    more = spark.createDataFrame([("/b", "class", 3), ("/a", "function", 4), ("/a", "method", 9)], "src string, kind string, n long")
    assert {r.file: tuple(r)[1:] for r in cluster.payload_sizes(nodes, edges, more).collect()} == {"/a": (1, 6, 2, 2), "/b": (3, 0, 0, 0)}


@pytest.mark.parametrize("name", ["entity_inherit", "node_display", "ui_degree", "enrich_others"])
def test_entities_stay_where_they_are_formed(spark, oracle, folder, name):
    got = registry.QUERIES[name](spark, folder)
    assert matches(got, registry.ORACLES[name], oracle, folder)
    got.collect()
    assert most(got, "shuffleRecordsWritten") < FEW < most(got, "numOutputRows")


def test_entities_of_files_alone(graph):
    """A file gives its community, another entity or an external of that id doesn't."""
    nodes, _ = graph(
        [("/a", "F", {"community": "m"}), ("/a::C", "class", {"community": "n"}), ("/a::C::f", "method"), ("x", "X", {"community": "dependencies"}), ("x::g", "function"), ("h", "function"), ("/a::::k", "function")], []
    )
    got = {r.id: (r.parent, r.community) for r in enrich.entity_communities(nodes).collect()}
    assert got == {"/a::C": ("/a", "m"), "/a::C::f": ("/a::C", "other"), "x::g": ("x", "other"), "h": ("h", "other"), "/a::::k": ("/a::", "other")}


def test_spread(spark, tmp_path, monkeypatch):
    """As many tasks form entities as there are entities for, even if one file has all customers."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS s_suppkey, 0 AS s_nationkey FROM range(100) t(i)) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"COPY (SELECT i AS c_custkey, 'c' AS c_name, 0 AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(2000) t(i)) TO '{tmp_path}/customer.parquet'")
    monkeypatch.setattr(adapters, "ENTITIES", 1000)
    per = [r["count"] for r in adapters.supply_entities(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 200_000 and len(per) == 8 and max(per) < 60_000


def test_paths_seen_from_the_top(spark):
    given = ["/", "//", "/a", "/a/b", "//a///b//", "/a /../b", "a//b", "", None, "/a/\nb/"]
    got = spark.createDataFrame([(p,) for p in given], "p string").select(columns.relative_path(F.col("p"), "/")).collect()
    assert [r[0] for r in got] == [p if p is None or not p.startswith("/") else "/".join(s for s in p.split("/") if s) for p in given]
    plan = spark.createDataFrame([("/a",)], "p string").select(columns.display(F.col("p"), F.col("p"), F.col("p"), F.lit(False)))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_degrees_counted_before(graph, spark):
    nodes, edges = graph([("a", "F"), ("b", "F"), ("c", "F"), ("d", "F")], [("a", "b"), ("a", "b"), ("c", "c")])
    more = spark.createDataFrame([("a", "class", 3), ("a", "method", 1), ("d", "class", 2)], "src string, kind string, n long")
    assert {tuple(r) for r in ui.degrees(nodes, edges, more).collect()} == {("a", 6), ("b", 2), ("c", 2), ("d", 2)}


def test_communities_of_rows_that_stand_for_many(spark):
    nodes = spark.createDataFrame([("m", 2), ("m", 1), (None, 4), ("", 3)], "community string, times long")
    assert {tuple(r) for r in ui.communities(nodes).collect()} == {("m", 3, None), ("other", 7, None)}
