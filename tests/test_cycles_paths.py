import random

from depweave.operators import cycles as C
from depweave.operators import query as Q
from depweave.operators.components import components


def found(graph, nodes, edges):
    ns, es = graph(nodes, edges)
    return [r.asDict(True) for r in C.detect_cycles(ns, es).orderBy("id").collect()]


def files(names):
    return [(n, "F") for n in names]


def test_two_and_three(graph):
    (c,) = found(graph, files("ab"), [("a", "b"), ("b", "a")])
    assert c["size"] == 2 and len(c["files"]) == 3 and c["label"] == "a → b → a" and c["edges"] == [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]
    (c,) = found(graph, files("abc"), [("a", "b"), ("b", "c"), ("c", "a")])
    assert [f["id"] for f in c["files"]] == ["a", "b", "c", "a"]


def test_separate_self_and_none(graph):
    assert len(found(graph, files("abcd"), [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")])) == 2
    assert [c["size"] for c in found(graph, files("a"), [("a", "a")])] == [1]
    assert found(graph, files("abc"), [("a", "b"), ("b", "c")]) == []


def test_only_files_count(graph):
    assert found(graph, files("ab") + [("express", "X")], [("a", "b"), ("b", "express"), ("express", "a")]) == []
    assert len(found(graph, files("ab") + [("b::e", "class")], [("a", "b"), ("b", "a"), ("b", "=b::e")])) == 1


def test_limit():
    n = 30
    out = {str(i): [str(j) for j in range(n)] for i in range(n)}
    assert len(C.depth_first(list(out), out, 200)) == 200


def walk(starts, out):
    """The walk as it would be told, by recursion."""
    seen, path, keys = set(), [], {}

    def go(v):
        seen.add(v)
        path.append(v)
        for w in out.get(v, ()):
            if w in path:
                c = path[path.index(w) :]
                m = c.index(min(c))
                keys.setdefault("|".join(c[m:] + c[:m]), [*c, w])
            elif w not in seen:
                go(w)
        path.pop()

    for s in starts:
        if s not in seen:
            go(s)
    return list(keys.values())


def test_walk_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        names = [str(i) for i in range(n)]
        out = {a: rng.sample(names, rng.randint(0, min(n, 3))) for a in names}
        assert C.depth_first(names, out) == walk(names, out)


def test_cyclic_nodes(graph):
    ns, es = graph(files("abcdef"), [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "e"), ("d", "f")])
    for enough in (0, 100):
        assert {r.id for r in C.cyclic_nodes(ns, es, enough).collect()} == {"b", "c", "e"}
    assert C.without_sinks(C._links(ns, es), enough=0).count() == 4


def test_strong_components_by_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        names = [str(i) for i in range(rng.randint(1, 9))]
        out = {a: rng.sample(names, rng.randint(0, min(len(names), 2))) for a in names}
        reach = {a: set(out[a]) for a in names}
        for _ in names:
            reach = {a: r.union(*(out[b] for b in r)) for a, r in reach.items()}
        assert {n for part in C.strong_parts(out) for n in part} == {a for a in names if a in reach[a]}


def test_shortest_path(graph):
    ns, es = graph(files("abcdez"), [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("d", "a")])
    assert Q.shortest_path(es, "a", "d") == ["a", "e", "d"]
    assert Q.shortest_path(es, "b", "a") == ["b", "c", "d", "a"]
    assert Q.shortest_path(es, "a", "a") == ["a"] and Q.shortest_path(es, "a", "z") is None
    assert Q.shortest_path(es, "z", "a") is None


def test_paths_by_brute_force(graph, spark):
    rng = random.Random(8)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(40)]
    _, es = graph(files(names), pairs)
    reach = {(r.root, r.id): r.depth for r in Q.distances(es, spark.createDataFrame([("n00",), ("n01",)], "id string")).collect()}
    for s in ("n00", "n01"):
        dist, level = {s: 0}, [s]
        while level:
            level = [b for a in level for x, b in pairs if x == a and b not in dist and not dist.update({b: dist[a] + 1})]
        assert {k[1]: d for k, d in reach.items() if k[0] == s} == dist
    far = max((d, i) for (s, i), d in reach.items() if s == "n00")
    path = Q.shortest_path(es, "n00", far[1])
    assert len(path) == far[0] + 1 and all(p in set(pairs) for p in zip(path, path[1:]))


def test_resolve(graph):
    ns, _ = graph([("/w/src/app.js", "F", {"label": "App"}), ("/w/src/apple.js", "F"), ("lodash", "X", {"label": "lodash"})], [])
    ids = lambda t, d="/w": [r.id for r in Q.resolve_node(ns, t, d).collect()]
    assert ids("lodash") == ["lodash"] and ids("src/app.js") == ["/w/src/app.js"] and ids("../w/./src/app.js", "/w") == ["/w/src/app.js"]
    assert ids("APP") == ["/w/src/app.js", "/w/src/apple.js"] and ids("nothing") == []


def test_neighbours(graph):
    ns, es = graph(files("ab") + [("a::f", "function")], [("a", "b"), ("a", "b"), ("a", "=a::f")])
    assert {r.id for r in Q.dependencies_of(ns, es, "a").collect()} == {"b", "a::f"}
    assert {r.id for r in Q.dependents_of(ns, es, "b").collect()} == {"a"}


def test_strong_components_in_spark(graph, spark):
    rng = random.Random(8)
    ids = [f"n{i:03d}" for i in range(40)]
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(50)] + [("n000", "n000")] + [(f"r{i:02d}", f"r{(i + 1) % 6:02d}") for i in range(6)]
    every = sorted({n for pair in links for n in pair})
    reach = {n: {n} for n in every}
    for _ in every:
        for a, b in links:
            reach[a] |= reach[b]
    want = {}
    for n in every:
        mine = [m for m in reach[n] if n in reach[m]]
        if len(mine) > 1:
            want[n] = max(mine)
    for enough in (0, 10**6):
        got = {r.id: r.component for r in C.strong_components(spark.createDataFrame(links, "src string, dst string"), enough).collect()}
        assert got == want and want["r00"] == "r05"
    ns, es = graph([(n, "F") for n in every], links)
    both = [{r.id for r in C.cyclic_nodes(ns, es, enough=k).collect()} for k in (0, 10**6)]
    assert both[0] == both[1] == set(want) | {a for a, b in links if a == b}
    assert C.strong_components(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).collect() == []


def test_eccentricity(spark):
    rng = random.Random(2)
    links = sorted({(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(90)})
    starts = [f"n{i:02d}" for i in range(61)] + [f"s{i:03d}" for i in range(100)]
    links += [(f"s{i:03d}", f"n{i % 61:02d}") for i in range(100)]
    most = 0
    for s in starts:
        depth, frontier, seen = 0, {s}, {s}
        while frontier := {b for a, b in links if a in frontier} - seen:
            depth += 1
            seen |= frontier
        most = max(most, depth)
    df = spark.createDataFrame(links, "src string, dst string")
    for enough in (0, 10**6):
        assert Q.eccentricity(df, spark.createDataFrame([(s,) for s in starts], "id string"), enough) == most
        assert Q.eccentricity(df, spark.createDataFrame([], "id string"), enough) == 0
    some = spark.createDataFrame([("n00",), ("n07",), ("none",)], "id string")
    both = [{tuple(r) for r in Q.distances(df, some, k).collect()} for k in (0, 10**6)]
    assert both[0] == both[1] and ("none", "none", 0) in both[0]
    for a, b in (("s000", "n30"), ("s050", "n07"), ("n03", "s001"), ("n00", "n00")):
        assert Q.shortest_path(df, a, b, enough=0) == Q.shortest_path(df, a, b)


def test_components_on_the_driver(spark):
    rng = random.Random(4)
    links = [(f"n{rng.randint(0, 200):03d}", f"n{rng.randint(0, 200):03d}") for _ in range(150)]
    df = spark.createDataFrame(links, "a string, b string")
    both = [{tuple(r) for r in components(df, enough).collect()} for enough in (0, 10**6)]
    assert both[0] == both[1] and components(df.where("false")).collect() == []
