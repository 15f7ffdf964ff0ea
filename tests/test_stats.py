import json
from depweave.operators import cycles as C
from depweave.operators import stats as S

JS, TS = {"language": "JavaScript"}, {"language": "TypeScript"}


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    return df.first().asDict()


def test_composition(graph):
    nodes, edges = graph([("index.js", "F"), ("util.js", "F"), ("index.js::Helper", "class"), ("express", "X", {"npm": True})], [("index.js", "util.js"), ("index.js", "express"), ("index.js", "=index.js::Helper")])
    assert one(S.composition(nodes)) == {"files": 2, "entities": 1, "classes": 1, "functions": 0, "methods": 0, "externals": 1, "npm_packages": 1}
    assert one(S.edge_composition(edges)) == {"dependency_edges": 2, "contains_edges": 1}


def test_empty(graph):
    nodes, edges = graph([], [])
    out = S.global_stats(nodes, edges)
    assert out["composition"]["files"] == 0 and out["health"]["circular_deps"] is None and out["health"]["max_dep_chain"] == 0
    assert out["health"]["avg_deps_per_file"] == 0 and out["languages"] == []


def test_languages(graph):
    nodes, edges = graph([("a.js", "F", JS), ("b.js", "F", JS), ("c.ts", "F", TS), ("a.js::Foo", "class")], [("a.js", "b.js"), ("a.js", "c.ts"), ("a.js", "=a.js::Foo")])
    assert rows(S.language_breakdown(nodes, edges)) == [("JavaScript", 2, 2, 1), ("TypeScript", 1, 0, 0)]


def test_languages_unknown(graph):
    nodes, edges = graph([("a", "F", {"language": ""}), ("b", "F")], [])
    assert rows(S.language_breakdown(nodes, edges)) == [("Unknown", 2, 0, 0)]


def test_hotspots(graph):
    nodes, edges = graph([("a", "F"), ("b", "F"), ("c", "F"), ("a::X", "class"), ("a::Y", "class")], [("a", "b"), ("a", "c"), ("b", "c"), ("a", "=a::X"), ("a", "=a::Y")])
    assert rows(S.most_imported(nodes, edges, 2)) == [("c", 2), ("b", 1)]
    assert rows(S.heaviest_importers(nodes, edges, 2)) == [("a", 2), ("b", 1)]
    assert rows(S.largest_files(nodes, edges, 2)) == [("a", 2)]


def test_top_is_clipped(graph):
    nodes, edges = graph([(f"f{i}", "F") for i in range(10)], [("f0", "f1"), ("f2", "f1")])
    assert rows(S.most_imported(nodes, edges, 1)) == rows(S.most_imported(nodes, edges, None)) == [("f1", 2)]


def test_entities_are_no_imports(graph):
    nodes, edges = graph([("a", "F"), ("a::Foo", "class"), ("a::Bar", "function")], [("a", "=a::Foo"), ("a", "=a::Bar")])
    assert rows(S.heaviest_importers(nodes, edges)) == [] and rows(S.largest_files(nodes, edges)) == [("a", 2)]


def test_isolation(graph):
    nodes, edges = graph([("connected", "F"), ("isolated", "F"), ("user", "F"), ("npm", "X")], [("connected", "connected"), ("user", "npm")])
    assert rows(S.isolated_files(nodes, edges)) == [("isolated",)]


def test_chain(graph):
    nodes, edges = graph([(n, "F") for n in "abcd"], [("a", "b"), ("b", "c"), ("c", "d")])
    assert one(S.max_dep_chain(nodes, edges)) == {"max_depth": 3}
    nodes, edges = graph([(n, "F") for n in "ab"], [("a", "b"), ("b", "a")])
    assert one(S.max_dep_chain(nodes, edges)) == {"max_depth": 0}


def test_coupling(graph):
    a, b = {"community": "module-a"}, {"community": "module-b"}
    nodes, edges = graph([("a", "F", a), ("b", "F", a), ("c", "F", b), ("lodash", "X")], [("a", "b"), ("a", "c"), ("c", "a"), ("a", "lodash")])
    assert one(S.coupling(nodes, edges)) == {"cross_edges": 2, "total_edges": 3, "cross_ratio": 2 / 3}
    assert S.global_stats(nodes, edges)["composition"]["cross_community_pct"] == 66.7


def test_parallel_edges(graph):
    nodes, edges = graph([("a", "F"), ("b", "F"), ("a::X", "class")], [("a", "b"), ("a", "b"), ("a", "=a::X")])
    assert one(S.health_ratios(nodes, edges)) == {"avg_deps": 0.5, "entity_density": 0.5}


def test_directories(graph):
    nodes, _ = graph([("/root/src/a.js", "F"), ("/root/src/b.js", "F"), ("/root/lib/c.js", "F")], [])
    assert rows(S.directory_breakdown(nodes)) == [("/root/src", 2), ("/root/lib", 1)]


def test_target_file(graph, spark):
    nodes, edges = graph(
        [("app", "F", JS), ("util", "F"), ("lodash", "X"), ("app::App", "class"), ("app::run", "function")],
        [("app", "util"), ("app", "lodash"), ("app", "=app::App"), ("app", "=app::run")],
    )
    got = one(S.target_stats(nodes, edges, "app"))
    want = {"type": "file", "kind": None, "out_deg": 4, "in_deg": 0, "total_deg": 4, "dependencies": 2, "dependents": 0, "classes": 1, "functions": 1, "methods": 0, "entities": 2, "is_isolated": False, "cycles": []}
    assert {k: got[k] for k in want} == want
    assert S.target_stats(nodes, edges, "nothing").collect() == []


def test_target_entity_and_external(graph):
    nodes, edges = graph([("app.js", "F", JS | {"community": "core"}), ("app.js::MyClass", "class"), ("express", "X", {"npm": True, "community": "dependencies"})], [("app.js", "=app.js::MyClass"), ("app.js", "express")])
    got = one(S.target_stats(nodes, edges, "app.js::MyClass"))
    assert (got["type"], got["kind"], got["parent_file"], got["language"], got["community"], got["in_deg"], got["out_deg"], got["dependents"]) == ("entity", "class", "app.js", "JavaScript", "core", 1, 0, 1)
    got = one(S.target_stats(nodes, edges, "express"))
    assert (got["type"], got["npm"], got["language"], got["community"], got["in_deg"], got["out_deg"]) == ("external", True, None, "dependencies", 1, 0)


def test_cycle_references(graph):
    nodes, edges = graph([(n, "F") for n in "abc"], [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")])
    found = C.detect_cycles(nodes, edges)
    assert one(S.target_stats(nodes, edges, "a", found))["cycles"] == [1, 2]
    assert one(S.target_stats(nodes, edges, "b", found))["cycles"] == [1]
    assert S.global_stats(nodes, edges, cycles=found)["health"]["circular_deps"] == 2
    assert S.global_stats(nodes, edges, cycles=found.limit(0))["health"]["circular_deps"] == 0


def test_rounding():
    from depweave.functions.columns import fixed

    assert fixed(0.15, 1) == 0.1 and fixed(1.005, 2) == 1.0 and fixed(2.5, 0) == 3 and fixed(200 / 3, 1) == 66.7


def test_asked_for_numbers_and_files(tmp_path):
    assert [S.how_many(x) for x in ("7", 3, "0", "x", None, "2.9", "inf")] == [7, 3, 5, 5, 5, 2, 5] and S.how_many("3", every=True) is None
    path = tmp_path / "a" / "b" / "stats.json"
    text = S.write_stats({"a": [1, None]}, str(path))
    assert json.loads(path.read_text()) == json.loads(S.write_stats({"a": [1, None]})) == {"a": [1, None]} and text == path.read_text()


def test_languages_with_entities_counted_before(graph, spark):
    nodes, edges = graph([("a.js", "F", JS), ("b.js", "F", JS), ("c.ts", "F", TS), ("a.js::Foo", "class")], [("a.js", "b.js"), ("a.js", "c.ts"), ("a.js", "=a.js::Foo")])
    more = spark.createDataFrame([("c.ts", "class", 5), ("c.ts", "method", 2), ("a.js", "function", 1)], "src string, kind string, n long")
    assert rows(S.language_breakdown(nodes, edges, more)) == [("JavaScript", 2, 2, 2), ("TypeScript", 1, 0, 7)]
    assert one(S.health_ratios(nodes, edges, more)) == {"avg_deps": 2 / 3, "entity_density": 3.0}


def test_largest_with_entities_counted_before(graph, spark):
    nodes, edges = graph([("a", "F"), ("b", "F"), ("c", "F"), ("a::X", "class")], [("a", "=a::X"), ("a", "=a::X"), ("a", "b")])
    more = spark.createDataFrame([("b", "class", 1), ("b", "method", 2), ("a", "function", 1), ("x", "class", 9)], "src string, kind string, n long")
    assert rows(S.largest_files(nodes, edges, tally=more)) == [("b", 3), ("a", 2)] and rows(S.largest_files(nodes, edges)) == [("a", 1)]


def test_composition_of_rows_that_stand_for_many(spark):
    nodes = spark.createDataFrame([(None, False, None, 2), ("class", False, None, 5), ("method", None, None, 3), ("entity", False, None, 1), (None, True, True, 4), (None, True, None, 6)], "kind string, external boolean, npm boolean, times long")
    assert one(S.composition(nodes)) == {"files": 2, "entities": 9, "classes": 5, "functions": 0, "methods": 3, "externals": 10, "npm_packages": 4}
    assert set(one(S.composition(nodes.where("false"))).values()) == {0}


def test_edges_that_stand_for_many(spark):
    edges = spark.createDataFrame([(None, 2), ("contains", 5), ("other", 1), ("contains", 1)], "relation string, times long")
    assert one(S.edge_composition(edges)) == {"dependency_edges": 3, "contains_edges": 6}
