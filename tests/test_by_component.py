"""Graphs of more links than one process follows, in tasks by connected component."""

import random

import pytest
from pyspark.sql import functions as F

from depweave.operators import components as P
from depweave.operators import cycles as C
from depweave.operators import enrich


def scattered(seed, groups=12, size=9, most=14):
    """Links within groups of nodes whose names, and so order, are mixed."""
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(groups * size)]
    rng.shuffle(names)
    return sorted({(rng.choice(mine), rng.choice(mine)) for g in range(groups) for mine in [names[g * size : (g + 1) * size]] for _ in range(most)})


def no_rounds(*_, **__):
    raise AssertionError("rounds in Spark or links on the driver")


def test_tasks_have_whole_components(spark):
    links = scattered(1) + [("alone", "alone")]
    df = spark.createDataFrame(links, "src string, dst string")
    work = lambda rows: [(a, b, sum(1 for _ in rows)) for a, b in rows]
    got, rest = P.by_component(df, work, "src string, dst string, n int", 20)
    assert rest is None and sorted((r.src, r.dst) for r in got.collect()) == sorted(links)
    least = {r.node: r.least for r in P.components(df.toDF("a", "b")).collect()}
    sizes = {}
    for a, _ in links:
        sizes[least.get(a, a)] = sizes.get(least.get(a, a), 0) + 1
    middle = sorted(sizes.values())[len(sizes) // 2]
    got, rest = P.by_component(df, work, "src string, dst string, n int", middle)
    assert {(r.src, r.dst) for r in rest.collect()} == {p for p in links if sizes[least.get(p[0], p[0])] > middle}
    assert {(r.src, r.dst) for r in got.collect()} == {p for p in links if sizes[least.get(p[0], p[0])] <= middle}
    assert P.by_component(df, work, "src string, dst string, n int", middle, split=False)[0].count() == len(links)


@pytest.mark.parametrize("enough", [6, 11, 60])
def test_strong_components(spark, monkeypatch, enough):
    """The same as one walk, whether a component has a task or rounds in Spark; no rounds if all have tasks."""
    links = scattered(2)
    df = spark.createDataFrame(links, "src string, dst string")
    want = {tuple(r) for r in C.strong_components(df, 10**6).collect()}
    if enough == 60:
        monkeypatch.setattr(C, "without_sinks", no_rounds)
    assert len(want) > 10 and {tuple(r) for r in C.strong_components(df, enough).collect()} == want


@pytest.mark.parametrize("limit", [3, 7, 200])
def test_cycles(graph, monkeypatch, limit):
    """Tasks find the cycles of one walk, in its order, up to the limit of all, whatever the order of files."""
    links = scattered(6)
    names = sorted({n for pair in links for n in pair})
    random.Random(5).shuffle(names)
    nodes, edges = graph([(n, "F", {"label": n.upper()}) for n in names], links)
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    want = C.depth_first(names, out, limit)
    monkeypatch.setattr(C, "without_sinks", no_rounds)
    for enough in (50, 10**6):
        got = C.detect_cycles(nodes, edges, limit, enough).orderBy("id").collect()
        assert [[f["id"] for f in r.files] for r in got] == want and [r.id for r in got] == list(range(1, len(want) + 1))
        assert all(r.label == C.ARROW.join(f["id"].upper() for f in r.files) for r in got)
    assert len(want) == limit or limit == 200 and len(want) > 20


def test_louvain(graph, monkeypatch):
    """Tasks find the communities that the driver finds, whatever the order of files; nothing moves in Spark."""
    links = scattered(3, most=22)
    names = sorted({n for pair in links for n in pair})
    random.Random(5).shuffle(names)
    nodes, edges = graph([(n, "F") for n in [*names, "alone"]], links)
    want = {r.id: r.community for r in enrich.louvain(nodes, edges, 10**6).collect()}
    monkeypatch.setattr(enrich, "_moves", no_rounds)
    got = {r.id: r.community for r in enrich.louvain(nodes, edges, 50).collect()}
    assert got == want and len(set(want.values())) > 12 and want["alone"] == "alone"


def test_cyclic_nodes(graph, monkeypatch):
    links = scattered(7, most=7)
    names = sorted({n for pair in links for n in pair})
    nodes, edges = graph([(n, "F") for n in names], links)
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    want = {n for part in C.strong_parts(out) for n in part}
    monkeypatch.setattr(C, "without_sinks", no_rounds)
    for enough in (30, 10**6):
        got = [r.id for r in C.cyclic_nodes(nodes, edges, enough).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_nodes_are_not_broadcast(spark, graph):
    """Tables of all nodes go neither to the driver nor from there to all tasks, however small their files are."""
    links = scattered(8)
    nodes, edges = graph([(n, "F") for n in sorted({n for pair in links for n in pair})], links)
    for df in (C._links(nodes, edges), enrich.undirected(nodes, edges), P._starred(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
