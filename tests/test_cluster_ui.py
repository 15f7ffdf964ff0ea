import os

import pytest

from depweave.operators import cluster as K
from depweave.operators import cycles, ui


def test_batches_and_payloads(graph):
    nodes, edges = graph(
        [(f"/f{i:02d}", "F", {"community": "m", "docstrings": ["d"] if not i else None}) for i in range(18)] + [("/z", "F", {"community": "n"}), ("/f00::C", "class", {"label": "C"}), ("/f00::f", "function", {"label": "f"}), ("/f00::m", "method", {"label": "m"}), ("/f00::e", "entity", {"label": "e"}), ("x", "X")],
        [("/f00", "=/f00::C"), ("/f00", "=/f00::f"), ("/f00", "=/f00::m"), ("/f00", "=/f00::e"), ("/f00", "x"), ("/f00", "x"), ("/f00", "/f01")],
    )
    sizes = sorted((r.community, r.batch, r["count"]) for r in K.batches(nodes).groupBy("community", "batch").count().collect())
    assert sizes == [("m", 0, 8), ("m", 1, 8), ("m", 2, 2), ("n", 0, 1)]
    told = {r.file: r for r in K.payloads(nodes, edges).collect()}
    r = told["/f00"]
    assert (r.ast_classes, r.ast_functions, r.ast_docstrings, r.graph_edges_to) == (["C"], ["f", "e"], ["d"], ["x", "/f01"])
    assert told["/z"].graph_edges_to == [] and len(told) == 19


def test_summaries(graph):
    nodes, edges = graph([(f"/f{i}", "F", {"community": "ab"[i % 2]}) for i in range(4)], [])

    def call(payload):
        if payload[0]["file"] == "/f1":
            raise RuntimeError("down")
        return " ".join(p["file"] for p in payload)

    out, failed = K.summarise(nodes, edges, call)
    assert {r.id: r.semantic_summary for r in out.collect()} == {"/f0": "/f0 /f2", "/f2": "/f0 /f2", "/f1": None, "/f3": None}
    assert [f["batch"] for f in failed] == [["/f1", "/f3"]] and failed[0]["error"] == "down"
    out, failed = K.summarise(out, edges, lambda p: "again", only=failed)
    assert {r.id: r.semantic_summary for r in out.collect()}["/f3"] == "again" and failed == []


def test_retry_waits():
    waits, calls = [], []

    def busy():
        calls.append(1)
        raise K.TooManyRequests

    with pytest.raises(K.TooManyRequests):
        K.call_with_retry(busy, sleep=waits.append)
    assert waits == [1, 2, 4, 8] and len(calls) == 5
    with pytest.raises(ValueError):
        K.call_with_retry(lambda: int("x"), sleep=waits.append)
    assert len(waits) == 4


def test_bucket():
    now = [0.0]
    waits = []
    bucket = K.TokenBucket(2, lambda: now[0], lambda s: waits.append(s))
    for _ in range(3):
        bucket.take()
    assert waits == [30.0]


def test_concurrency():
    assert [K.concurrency(x) for x in (None, "3", 9, 0, "x", -1)] == [2, 3, 5, 2, 2, 2]
    seen = []
    assert K.map_concurrently([1, 0, 2], 2, lambda x: 6 // x, seen.append)[0] == (6, None) and sorted(seen) == [1, 2, 3]


def test_viewer(graph):
    nodes, edges = graph(
        [("a", "F", {"label": "Alpha", "community": "m", "color": "red", "x": 0.0, "y": 5.0}), ("b", "F", {"label": "beta", "community": "m", "color": "blue", "x": 10.0, "y": 5.0}), ("n", "X", {"npm": True, "community": "dependencies"}), ("o", "X", {"community": "dependencies"}), ("a::e", "class", {"label": "e"})],
        [("a", "b"), ("a", "a"), ("a", "n"), ("a", "=a::e"), ("b", "a")],
    )
    assert {r.id: r.degree for r in ui.degrees(nodes, edges).collect()} == {"a": 6, "b": 2, "n": 1, "o": 0, "a::e": 1}
    got = {r.id: tuple(r)[1:] for r in ui.sizes(nodes, edges).collect()}
    assert got == {"a": (23, "file", "m"), "b": (11, "file", "m"), "n": (8, "external", "dependencies"), "o": (8, "external", "dependencies"), "a::e": (5, "class", "other")}
    drawn = {(r.src, r.dst): tuple(r)[2:] for r in ui.drawn_edges(nodes, edges).collect()}
    assert drawn["a", "a::e"] == ("contains", True, 1, "red") and drawn["b", "a"] == ("imports", False, 2, "blue")
    assert {tuple(r) for r in ui.communities(nodes, "ord").collect()} == {("m", 2, "red"), ("dependencies", 2, None), ("other", 1, None)}
    assert [r.community for r in ui.legend(nodes).collect()] == ["m", "other"]
    assert [r.id for r in ui.search(nodes, "A", order="ord").collect()] == ["a", "b"]
    assert {r.id for r in ui.visible(nodes, packages_only=True, entities=False).collect()} == {"a", "b", "n"}
    assert {r.id for r in ui.visible(nodes, hidden=["m"]).collect()} == {"n", "o", "a::e"} and {r.id for r in ui.visible(nodes, only="m").collect()} == {"a", "b"}
    assert {r.id for r in ui.connected(edges, "b").collect()} == {"a"}
    on_nodes, on_edges = ui.in_cycles(nodes, edges, cycles.detect_cycles(nodes, edges))
    assert {r.id for r in on_nodes.collect()} == {"a", "b"} and on_edges.count() == 3
    assert tuple(ui.bounds(nodes).first()) == (-0.5, -45.0, 11.0, 100.0)


def test_the_service():
    sent = []

    def post(body, answers=iter([(200, '{"choices": [{"message": {"content": "good"}}]}'), (200, "{}"), (429, ""), (500, "down")])):
        sent.append(body)
        return next(answers)

    call = K.service(post, "some-model")
    assert call([{"file": "a"}]) == "good" and call([]) == ""
    with pytest.raises(K.TooManyRequests):
        call([])
    with pytest.raises(RuntimeError, match="500: down"):
        call([])
    assert sent[0]["model"] == "some-model" and sent[0]["temperature"] == 0.3 and sent[0]["max_tokens"] == 1024
    assert [m["role"] for m in sent[0]["messages"]] == ["system", "user"] and '"file": "a"' in sent[0]["messages"][1]["content"]


def test_credentials(tmp_path):
    path = str(tmp_path / "c" / "config.json")
    assert K.credentials(path, {}, "KEY") is None
    assert K.credentials(path, {}, "KEY", ask={"key": "k1", "model": "m1"}.get) == ("k1", "m1") == K.credentials(path, {}, "KEY")
    assert K.credentials(path, {"KEY": "k2"}, "KEY", model="m2") == ("k2", "m2") and K.credentials(path, {}, "KEY") == ("k1", "m2")
    assert K.credentials(path, {}, "KEY", reset=True) is None
    assert K.read_settings(str(tmp_path / "none")) == {} and os.stat(path).st_mode & 0o077 == 0
