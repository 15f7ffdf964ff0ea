import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depweave.llm import ann as A
from depweave.llm import lm_scoring as P
from depweave.llm import subword as S
from depweave.llm import tokenization as T

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def vocab():
    return S.vocabulary()


def tiny(extra=()):
    pieces = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "▁▁", "a", "b", "ab", "aba", "▁a", "▁ab", "ba", "aa", "aaa", "c", *extra]
    scores = [0.0] * 259 + [-float((i * 7) % 11 + 2) for i in range(len(pieces) - 259)]
    return S.Vocabulary(pieces, scores, [2, 3, 3] + [6] * 256 + [1] * (len(pieces) - 259))


def best(v, text):
    """The best segmentation by looking at all pieces at all places."""
    known = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kind)) if k in (1, 4)}
    text = (S.SPACE + text).replace(" ", S.SPACE) if text else ""
    table = [(0.0, [])] + [(-math.inf, None)] * len(text)
    for i in range(len(text)):
        for k in range(1, min(v.longest, len(text) - i) + 1):
            p = known.get(text[i : i + k])
            ids = [p] if p is not None else [int(v.byte_ids[b]) for b in text[i].encode()] if k == 1 else None
            if ids is not None:
                value = table[i][0] + (v.score[p] if p is not None else v.unk_score)
                if value > table[i + k][0]:
                    table[i + k] = (value, table[i][1] + ids)
    return table[-1][1]


TEXTS = ["", "a", "ab aba  aab", " a", "  ", "é a", "x", "abab\nab", "日本 aa", "a" * 100, "ab" * 60 + " c", "▁ab", "\U0001f600 b", "a   b    "]


@pytest.mark.parametrize("extra", [(), ("b▁a",)])
def test_encoding_by_brute_force(extra):
    v = tiny(extra)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("aabbc é") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    ids, at = v.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == best(v, t), t


def test_stream_and_lockstep_agree(vocab):
    texts = [t for t in open(S.__file__, encoding="utf-8").read().split("\n\n") if t][:40]
    ids, at = vocab.encode(pa.array(texts))
    for i, t in enumerate(texts):
        flat = np.array(list(vocab.stream(S.SPACE + t.replace(" ", S.SPACE))), np.int32)
        assert vocab._spell(np.zeros(len(flat), int), flat)[1].tolist() == ids[at[i] : at[i + 1]].tolist() == best(vocab, t)


def test_stream_gives_out_early(vocab):
    """Ids come while the text is still being read, and what is held stays within a few windows."""
    read = 0

    def chunks(word, times):
        nonlocal read
        for _ in range(times):
            read += 1
            yield word

    stream = vocab.stream(chunks("▁the", 20000))
    assert next(stream) >= 0 and read < 20
    held = []
    state = vocab.stream(chunks("▁the▁quick▁brown▁fox", 20000), watch=held.append)
    n = sum(1 for _ in state)
    assert n >= 80000 and max(held) < 20 * vocab.longest
    for text in ("a" * 5000, "ab" * 3000 + "▁c", "▁" + "xyz" * 1500, "é" * 700, ""):
        whole = list(vocab.stream(text))
        for size in (1, 7, 1000):
            assert list(vocab.stream(text[i : i + size] for i in range(0, len(text), size))) == whole


def test_no_worse_than_the_library(vocab):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(S.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1  # the library's own search for the best path, over the same scores
    theirs = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for t in ("Hello world", "a long sentence of several words, for the search", "données étranges"):
        mine, _ = vocab.encode(pa.array([t]))
        assert vocab.score[mine].sum() >= vocab.score[theirs.encode(t)].sum()
        assert theirs.decode(mine.tolist()) == t


def test_round_trip_edges(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*TEXTS, None, "x" * 200000, "word " * 50000])]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], DOCS + ", coded string, ids int")
    got = T.encode(df)
    held = {r.doc_id: r for r in got.collect()}
    text = {r.doc_id: r.text for r in T.decode(got.select("doc_id", "ids")).collect()}
    for i, t, *_ in rows:
        lossy = t is not None and S.SPACE in t
        assert held[i].lossless == (None if t is None else not lossy) and text[i] == (t if not lossy else t.replace(S.SPACE, " ")) and held[i].coded == "q"
        assert held[i].n_ids == (None if t is None else len(held[i].ids)) or t is None
    assert T.encode(df.where("false")).collect() == []


def test_decoding_edges(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, 2, -5, 10**6]), (4, [None, 3 + 0xE9]), (5, [0])], "i int, ids array<int>")
    assert {r.i: r.text for r in T.decode(df).collect()} == {1: None, 2: "", 3: "", 4: "�", 5: "⁇ "}


def test_query_is_lossless(spark):
    got = T.op6_sentencepiece(spark, SF)
    assert got.where("not lossless").count() == 0 and got.count() == 200


def total(v, log_p, text):
    """The summed probability of all segmentations, one by one."""
    known = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kind)) if k in (1, 4)}

    def go(i):
        if i == len(text):
            return [0.0]
        out = []
        for k in range(1, min(v.longest, len(text) - i) + 1):
            p = known.get(text[i : i + k])
            if p is not None:
                out += [log_p[p] + r for r in go(i + k)]
            elif k == 1:
                out += [sum(log_p[v.byte_ids[b]] for b in text[i].encode()) + r for r in go(i + 1)]
        return out

    return float(np.logaddexp.reduce(go(0)))


def test_likelihood_by_brute_force():
    v = tiny()
    log_p = P.file_log_probabilities(v)
    assert abs(np.exp(log_p).sum() - 1) < 1e-9
    lattice = P.Lattice(v, log_p)
    words = ["", "a", "ab", "abaab", "é", "aaaab", " a", "xaby"]
    other = np.log(np.random.default_rng(1).dirichlet(np.ones(len(log_p))))
    got, beside = P.Lattice(v, log_p, other).forward(words)
    assert (got == lattice.forward(words)[0]).all() and (beside == P.Lattice(v, other).forward(words)[0]).all()
    for w, g in zip(words, got):
        text = S.SPACE + w.replace(" ", S.SPACE)
        assert g == pytest.approx(total(v, log_p, text)) == pytest.approx(lattice.stream(text))


def test_expected_counts():
    v = tiny()
    log_p = P.file_log_probabilities(v)
    words, times = ["ab", "aab", "é", "aba" * 30], np.array([2.0, 1.0, 3.0, 1.0])
    counts = P.Lattice(v, log_p).expected(words, times)
    chars = sum(counts[i] * len(p) for i, (p, k) in enumerate(zip(v.pieces, v.kind)) if k == 1)
    assert chars == pytest.approx(sum(n * (len(w) + 1) for w, n in zip(words, times)) - 3) and counts[v.byte_ids].sum() == pytest.approx(6)
    eps = 1e-5
    i = v.pieces.index("ab")  # the gradient of the likelihood by a piece's log probability is its expected count
    up, down = log_p.copy(), log_p.copy()
    up[i] += eps
    down[i] -= eps
    slope = (P.Lattice(v, up).forward(words)[0] - P.Lattice(v, down).forward(words)[0]) @ times / (2 * eps)
    assert counts[i] == pytest.approx(slope, rel=1e-4)


def test_scores(spark):
    rows = [(1, "the same words again", "en", "s", 1), (2, "the same words again", "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (5, "日本 zq", "en", "s", 1), (6, "the  words", "en", "s", 1), (7, "k" * 5000, "en", "s", 1)]
    rows += [(10 + i, "the words of the corpus", "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", scored int")
    got = {r.doc_id: r for r in P.lm_score(df, corpus=True).collect()}
    alone = {r.doc_id: r for r in P.lm_score(df.where("doc_id < 10")).collect()}
    assert all(alone[i].log_prob == got[i].log_prob for i in alone) and "corpus_log_prob" not in alone[1]
    assert got[1].log_prob == got[2].log_prob < 0 and got[3].log_prob is None and got[4].log_prob == 0 and got[4].bits_per_char is None
    assert got[1].bits_per_char < got[5].bits_per_char
    assert P.lm_score(df.where("false")).collect() == []
    v = S.vocabulary()
    fitted = P.fit_unigram(df)
    for lattice, column in ((P.Lattice(v, P.file_log_probabilities(v)), "log_prob"), (P.Lattice(v, fitted), "corpus_log_prob")):
        for i in (1, 5, 6, 7):
            text = {r[0]: r[1] for r in rows}[i]
            assert got[i][column] == pytest.approx(lattice.stream(S.SPACE + text.replace(" ", S.SPACE)))
    assert got[10].corpus_bits_per_char < got[10].bits_per_char


def test_likelihood_query(spark):
    """The query on a scale's whole table, against one walk over each text's lattice."""
    got = {r.doc_id: r for r in P.op10_lattice_likelihood(spark, SF).collect()}
    docs = spark.read.parquet(SF + "/documents.parquet").toPandas()
    assert set(got) == set(docs.doc_id)
    v = S.vocabulary()
    lattice = P.Lattice(v, P.file_log_probabilities(v))
    for i, text in zip(docs.doc_id[:25], docs.text[:25]):
        want = lattice.stream((S.SPACE + text[:4000]).replace(" ", S.SPACE)) if len(text) <= 4000 else None
        assert want is None or got[i].log_prob == pytest.approx(want, rel=1e-9)
        assert got[i].bits_per_char == pytest.approx(-got[i].log_prob / math.log(2) / len(text))


def test_rotation_keeps_lengths_and_axes():
    x = np.random.default_rng(0).normal(size=(50, 16)).astype(np.float32)
    assert np.allclose(np.linalg.norm(A.rotate(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    plan = A.Plan((16, 4), 1, 1)
    first, second = A.axes(x, plan, 0)
    codes = A.probes(x, plan, 0, 6)
    assert (codes[:, 0] == first.argmax(axis=1) * 8 + second.argmax(axis=1)).all()
    assert all(len(set(r)) == 6 for r in codes)


@pytest.mark.parametrize("n", [3000])
def test_recall(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24)) + 1.5 * rng.normal(size=(30, 24))[rng.integers(0, 30, n)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in A.nearest(df).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbor, r.cosine))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :10]
    hits = np.mean([len({b for _, b, _ in got.get(i, [])} & set(true[i])) / 10 for i in range(n)])
    assert hits >= 0.9
    for i, found in got.items():
        assert [f[0] for f in sorted(found)] == list(range(1, len(found) + 1))
        assert all(abs(c - s[i, b]) < 1e-5 for _, b, c in found)


def test_recall_holds_where_no_plan_reaches_it(spark, monkeypatch):
    monkeypatch.setattr(A, "BUCKET", 10)
    monkeypatch.setattr(A, "TABLES", (1,))
    monkeypatch.setattr(A, "MOST_PROBES", 2)
    x = np.random.default_rng(4).normal(size=(500, 32))
    got = A.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, : A.NEIGHBOURS]) for j in row}
    assert len({(r.vec_id, r.neighbor) for r in got} & want) >= 0.95 * len(want)


def by_brute_force(rows, k=10):
    """{id: {neighbour: cosine}} of all others, the best of ids with several vectors, and the k-th best cosine."""
    u = np.array([v for _, v in rows], np.float32).astype(np.float64)
    u = (u / np.linalg.norm(u, axis=1)[:, None]).astype(np.float32).astype(np.float64)
    s = u @ u.T
    out = {}
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            if a != b:
                mine = out.setdefault(a, {})
                mine[b] = max(mine.get(b, -2), round(s[i, j], 9))
    return {a: sorted(((-c, b) for b, c in mine.items()))[:k] for a, mine in out.items()}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_text_ids_and_equal_vectors(spark, kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(25, 16))
    vectors = [(centres[i % 25] + 0.1 * rng.normal(size=16)).tolist() for i in range(300)]
    rows = [(f"v{i:05d}" if kind == "string" else i, v) for i, v in enumerate(vectors)]
    same = rng.normal(size=16).tolist()
    rows += [(f"w{i:05d}" if kind == "string" else 1000 + i, same) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[0]], f"vec_id {kind}, embedding array<double>")
    want = by_brute_force(rows)
    got = {}
    for r in A.nearest(df).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((-r.cosine, r.neighbor))
    assert set(got) == set(want) and all(len(set(x)) == 10 for x in got.values())
    assert np.mean([len(set(b for _, b in got[i]) & set(b for _, b in want[i])) / 10 for i in want]) > 0.95
    for i in got:  # ties are in order, whole groups of equal vectors are met
        assert got[i] == sorted(got[i])
        if i in dict(rows[300:]):
            assert [b for _, b in got[i]] == [b for _, b in want[i]]


def test_many_equal_vectors(spark):
    n = 50000
    df = spark.range(n).selectExpr("id as vec_id", "array(1.0D, 2.0D, 3.0D) as embedding")
    got = A.nearest(df, k=3)
    assert got.count() == 3 * n and got.where("neighbor > 3").count() == 0
    assert [tuple(r) for r in got.where("vec_id = 1").orderBy("rank").select("neighbor", "rank").collect()] == [(0, 1), (2, 2), (3, 3)]


def test_neighbour_edges(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.1, 0.0]), (3, [1.0, 0.1, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [None, 1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, bucket int")
    got = A.nearest(df, k=2).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 9}
    assert [(r.neighbor, r.cosine) for r in sorted(got, key=lambda r: r["rank"]) if r.vec_id == 1] == [(2, 1.0), (3, pytest.approx(0.995037, abs=1e-5))]
    several = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])], "vec_id long, embedding array<float>")
    both = {(r.vec_id, r.neighbor) for r in A.nearest(several, k=2).collect()}
    assert both >= {(1, 2), (1, 3), (2, 1), (3, 1)} and all(a != b for a, b in both)
    assert A.nearest(df.where("false")).collect() == []
    assert A.nearest(df.where("vec_id = 4")).collect() == []


def by_brute_force_of(ids, x, asked, k=10):
    """{id: {neighbour: cosine}} of those asked, among all."""
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = u[asked] @ u.T
    s[np.arange(len(s)), np.flatnonzero(asked)] = -9
    return {int(ids[i]): {int(ids[j]): row[j] for j in np.argsort(-row, kind="stable")[:k]} for i, row in zip(np.flatnonzero(asked), s)}


def test_few_ask_among_all(spark):
    """The query: every fiftieth row asks, all rows are found."""
    got = {}
    for r in A.op8_cross_polytope_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.vec_id, {})[r.neighbor] = r.cosine
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    want = by_brute_force_of(table.vec_id.to_numpy(), np.stack(table.embedding), table.vec_id.to_numpy() % 50 == 0)
    assert set(got) == set(want) and len(got) == 40 and all(len(found) == 10 for found in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.95
    assert all(c == pytest.approx(want[i][j], abs=1e-6) for i in want for j, c in got[i].items() if j in want[i])
    assert any(j % 50 for found in got.values() for j in found)


def test_few_ask_in_sliced_buckets(spark, monkeypatch):
    """Slices of a bucket lie in several parts; all are asked, so that what isn't probed is all that's missed."""
    monkeypatch.setattr(A, "SLICE", 16)
    x = np.random.default_rng(9).normal(size=(2000, 16)) + 2 * np.random.default_rng(8).normal(size=(20, 16))[np.arange(2000) % 20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in A.nearest(df, asked=F.when(F.col("vec_id") != 100, F.col("vec_id") % 50 == 0)).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbor)
    want = by_brute_force_of(np.arange(2000), x, np.arange(2000) % 50 == 0)
    assert set(got) == set(want) - {100}  # where the condition is null, it doesn't hold
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in got]) >= 0.95


def test_asked_alone_are_sent_to_probed_buckets():
    """What is compared grows with those who ask, every vector is stored once a table, in the bucket asked first."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for asked, slices in ((np.arange(500) % 50 == 0, 1), (np.arange(500) % 50 == 0, 3), (np.ones(500, bool), 1), (np.zeros(500, bool), 2)):
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(asked)], names=["id", "vec", "asked"])
        stored, asks = {}, {}
        for out in A._spread(A.Plan((8,), 3, 4), 5, slices)(iter([batch])):
            for r in out.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["place"], np.int32)]
                for i, key, own in zip(ids, np.frombuffer(r["bucket"], np.int64), np.frombuffer(r["own"], bool)):
                    (stored if own else asks).setdefault(int(i), []).append(int(key))
        assert len(stored) == 500 and all(len(keys) == 3 for keys in stored.values())
        assert set(asks) == set(np.flatnonzero(asked)) and all(len(set(keys)) == 3 * 4 * slices for keys in asks.values())
        assert all(set(stored[i]) <= set(asks[i]) for i in asks)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_few_ask_among_equal_vectors(spark, kind):
    rng = np.random.default_rng(6)
    name = (lambda i: f"v{i:05d}") if kind == "string" else (lambda i: i)
    rows = [(name(i), rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(name(200 + i), rows[i % 3][1]) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[0]], f"vec_id {kind}, embedding array<double>")
    some = [name(0), name(5), name(210), name(259)]
    want = by_brute_force(rows)
    got = {}
    for r in A.nearest(df, asked=F.col("vec_id").isin(some)).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((-r.cosine, r.neighbor))
    assert set(got) == set(some) and all(len(found) == 10 for found in got.values())
    for i in (name(0), name(210), name(259)):  # whole groups of equal vectors are met, who asks or not
        assert [b for _, b in got[i]] == [b for _, b in want[i]]
    assert A.nearest(df, asked=F.lit(False)).collect() == [] and A.nearest(df.selectExpr("vec_id", "array(0.0D) as embedding")).collect() == []
