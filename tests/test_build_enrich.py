import random
from collections import Counter

import pytest

from depweave.functions import columns as C
from depweave.operators import build, enrich
from depweave.schema import PARSED


@pytest.fixture(scope="module")
def built(spark):
    def make(records, packages=None):
        rows = []
        for i, (id_, deps, found) in enumerate(records):
            found = found if isinstance(found, dict) else {"flat": found}
            rows.append((id_, deps, tuple(found.get(k, []) for k in ("classes", "functions", "methods", "docstrings", "flat")), False, i))
        names = spark.createDataFrame([(p,) for p in packages], "name string") if packages else None
        nodes, edges = build.build_graph(spark.createDataFrame(rows, PARSED), names)
        return nodes, edges, {r.id: r for r in nodes.orderBy("ord").collect()}, [tuple(r) for r in edges.orderBy("ord").select("src", "dst", "relation", "relationship").collect()]

    return make


def test_empty(built):
    _, _, nodes, edges = built([])
    assert nodes == {} and edges == []


def test_entities(built):
    _, _, nodes, edges = built([("/a.js", [], {"classes": ["App", "App", "A"], "functions": ["format", "A"], "methods": ["run", "#drain"], "docstrings": ["Does"]})])
    assert {k: r.kind for k, r in nodes.items()} == {"/a.js": None, "/a.js::App": "class", "/a.js::A": "class", "/a.js::format": "function", "/a.js::run": "method", "/a.js::#drain": "method"}
    assert list(nodes) == ["/a.js", "/a.js::App", "/a.js::A", "/a.js::format", "/a.js::run", "/a.js::#drain"]
    assert nodes["/a.js"].docstrings == ["Does"] and edges.count(("/a.js", "/a.js::App", "contains", None)) == 1 and len(edges) == 5


def test_flat_entities(built):
    _, _, nodes, _ = built([("/a.rs", [], ["Helper", "Helper"])])
    assert nodes["/a.rs::Helper"].kind == "entity" and nodes["/a.rs"].docstrings is None


def test_imports(built):
    _, _, nodes, edges = built(
        [("/p/src/app.js", ["./util.js", "../lib/helper.js", "express", "lodash", "./missing.js", "..\\other.js", "./util.js", "beside.js", ""], {}), ("/p/src/util.js", [], {}), ("/p/lib/helper.js", [], {}), ("/p/src/beside.js", ["express"], {})],
        ["express"],
    )
    imports = [(s, d) for s, d, _, how in edges if how == "imports"]
    assert imports == [("/p/src/app.js", d) for d in ("/p/src/util.js", "/p/lib/helper.js", "express", "lodash", "/p/src/util.js", "/p/src/beside.js", "")] + [("/p/src/beside.js", "express")]
    assert nodes["express"].npm and not nodes["lodash"].npm and nodes["lodash"].external and list(nodes)[-3:] == ["express", "lodash", ""]


def test_failed_records_leave_nothing(spark):
    nodes, edges = build.build_graph(spark.createDataFrame([("/a.js", [], ([], [], [], [], []), True, 0)], PARSED))
    assert nodes.count() == edges.count() == 0


def test_path_expressions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("/a/b", "../c/./d"), ("/a/b", "/x//y/../z"), ("/a", "../../.."), ("/", "q")], "f string, d string")
    assert [r[0] for r in df.select(C.resolve(F.col("f"), F.col("d"))).collect()] == ["/a/c/d", "/x/z", "/", "/q"]
    df = spark.createDataFrame([("/w/a.js::A::b",), ("/w/.env",), ("/w/x.test.TSX",), ("plain",), ("/w/no",)], "p string")
    assert [tuple(r) for r in df.select(C.parent(F.col("p")), C.extension(F.col("p")), C.dirname(F.col("p"))).collect()] == [
        ("/w/a.js::A", ".js::A::b", "/w"), ("/w/.env", "", "/w"), ("/w/x.test.TSX", ".TSX", "/w"), ("plain", "", "."), ("/w/no", "", "/w"),
    ]
    df = spark.createDataFrame([("/w/a/b",), ("/w",), ("/v/c",), ("lodash",)], "p string")
    assert [r[0] for r in df.select(C.relative_path(F.col("p"), "/w")).collect()] == ["a/b", "", "../v/c", "lodash"]
    df = spark.createDataFrame([(["c", "a", "b"],), (["a"],)], "p array<string>")
    assert [r[0] for r in df.select(C.rotation(F.col("p"))).collect()] == ["a|b|c", "a"]


@pytest.mark.parametrize(("paths", "root"), [([], ""), (["/a/b/x.js"], "/a/b"), (["/a/x", "/b/x"], "/"), (["/a/b/x", "/a/bc/x"], "/a")])
def test_common_root(spark, paths, root):
    assert C.common_root(spark.createDataFrame([(p,) for p in paths], "path string")) == root


def test_enrich(built):
    nodes, edges, *_ = built(
        [(f"/r/foo/src/{c}{i}.ts", [f"./{c}{(i + 1) % 3}.ts"], {}) for c in "xy" for i in range(3)]
        + [("/r/lonely.xyz", [], {}), ("/r/app.js", ["lodash"], {"classes": ["K"], "functions": ["f"], "methods": ["m"]}), ("/r/lib.rs", [], ["E"])]
    )
    got = {r.id: r for r in enrich.enrich(nodes, edges).collect()}
    names = {got[f"/r/foo/src/{c}{i}.ts"].community for c in "xy" for i in range(3)}
    assert names == {"foo/src #1", "foo/src #2"} and got["/r/foo/src/x0.ts"].community == got["/r/foo/src/x1.ts"].community == "foo/src #1"
    assert got["lodash"].community == "dependencies" and got["lodash"].color == "#2d6a4f"
    for e in ("K", "f", "m"):
        assert (got[f"/r/app.js::{e}"].size, got[f"/r/app.js::{e}"].color, got[f"/r/app.js::{e}"].community) == (3, "#6a2d6a", got["/r/app.js"].community)
    assert got["/r/lonely.xyz"].language == "Unknown" and got["/r/app.js"].language == "JavaScript" and got["/r/foo/src/x0.ts"].language == "TypeScript"
    assert got["/r/lonely.xyz"].color in enrich.PALETTE and got["/r/app.js"].label == "app.js" and got["/r/app.js::K"].label == "K"
    assert all(5 <= r.size <= 15 for r in got.values() if "::" not in r.id) and all(0 <= r.x < 100 for r in got.values())


def test_enrich_without_files(built):
    nodes, edges, *_ = built([])
    assert enrich.enrich(nodes, edges).count() == 0


def modularity(links, part):
    m = len(links)
    deg = {}
    for a, b in links:
        deg[a] = deg.get(a, 0) + 1
        deg[b] = deg.get(b, 0) + 1
    q = sum(part[a] == part[b] for a, b in links) / m
    for c in set(part.values()):
        q -= (sum(d for n, d in deg.items() if part[n] == c) / (2 * m)) ** 2
    return q


def test_louvain_invariants():
    import random

    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(2, 25)
        names = [f"n{i}" for i in range(n)]
        links = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(rng.randint(1, 50))})
        part = enrich.louvain_partition(names, links)
        assert set(part) == set(names) and part == enrich.louvain_partition(names, links)
        assert modularity(links, part) >= modularity(links, {x: x for x in names}) - 1e-9
    two = [(a, b) for g in ("abcd", "efgh") for a in g for b in g if a < b] + [("d", "e")]
    part = enrich.louvain_partition(list("abcdefgh"), two)
    assert len({part[x] for x in "abcd"}) == len({part[x] for x in "efgh"}) == 1 and part["a"] != part["h"]


def test_louvain_stays_in_components(graph):
    ns, es = graph([(n, "F") for n in "abcdef"] + [("ext", "X")], [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("a", "ext"), ("c", "ext")])
    got = {r.id: r.community for r in enrich.louvain(ns, es).collect()}
    assert set(got) == set("abcdef") and got["a"] == got["b"] == "a" and got["f"] == "f" and got["c"] not in ("a", "f")


def test_louvain_in_spark(graph):
    """Moves in Spark reach what moves on the driver reach, on groups that hang together by single links."""
    rng = random.Random(11)
    links = []
    for g in range(12):
        mine = [f"/g{g:02d}/f{i}" for i in range(9)]
        links += [(a, b) for i, a in enumerate(mine) for b in mine[i + 1 :] if rng.random() < 0.7]
        links += [(mine[0], f"/g{(g + 1) % 12:02d}/f0")] if g != 11 else []
    links += [("/far/a", "/far/b")]
    names = sorted({n for pair in links for n in pair})
    ns, es = graph([(n, "F") for n in [*names, "/alone"]], links)
    degree = Counter(n for pair in links for n in pair)

    def modularity(part):
        mass = Counter()
        for n, d in degree.items():
            mass[part[n]] += d
        return sum(part[a] == part[b] for a, b in links) / len(links) - sum(m * m for m in mass.values()) / (2 * len(links)) ** 2

    reached = []
    for enough in (0, 40, 10**6):
        got = {r.id: r.community for r in enrich.louvain(ns, es, enough).collect()}
        assert set(got) == {*names, "/alone"} and got["/alone"] == "/alone" and len({got["/far/a"], got["/far/b"]}) == 1
        assert all(got[c] == c for c in got.values()) and got["/far/a"] not in {c for n, c in got.items() if n.startswith("/g")}
        reached.append(modularity(got))
    assert min(reached) > 0.95 * max(reached) > 0.7
