import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depweave.llm import exact_dedup as E
from depweave.llm import near_dedup as N

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, more="", extra=()):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], DOCS + more)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
@pytest.mark.parametrize("bits", [8, 44, 62])
def test_golomb_round_trip(n, bits):
    rng = np.random.default_rng(n + bits)
    values = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64))
    values[: n // 3] = values[n // 2] if n else 0
    values = np.sort(values)
    k, code = E.golomb_encode(values, float(1 << bits))
    assert (E.golomb_decode(n, k, code) == values).all()


def test_golomb_is_small():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 44, 10000, dtype=np.uint64))
    assert len(E.golomb_encode(values, float(1 << 44))[1]) * 8 / 10000 < 44 - np.log2(10000) + 2.2


def kept(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect()), key=repr)


def test_exact_edges(spark):
    rows = [(5, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (7, None), (8, None), (9, ""), (10, ""), (11, "A"), (12, "a "), (3, "a"), (20, "x" * 300000), (21, "x" * 300000), (22, "x" * 299999)]
    got = E.exact_dedup(docs(spark, rows))
    assert kept(got) == sorted([(False, 3, "a"), (True, 0, "b"), (False, 7, None), (False, 8, None), (False, 9, ""), (False, 11, "A"), (False, 12, "a "), (False, 20, "x" * 300000), (False, 22, "x" * 299999)], key=repr)


def test_exact_empty_and_extra_columns(spark):
    assert E.exact_dedup(docs(spark, [])).collect() == []
    wide = docs(spark, [(1, "a"), (2, "a"), (3, "b")], ", dedup_part string, dedup_flag int, `a.b` int, bucket int", ("p", 1, 2, 3))
    got = E.exact_dedup(wide)
    assert got.columns == wide.columns and {r.doc_id for r in got.collect()} == {1, 3}


def test_exact_survives_colliding_fingerprints(spark):
    rows = [(i, f"text {i % 150}") for i in range(400)]
    got = E.exact_dedup(docs(spark, rows), bits=10)
    assert {r.doc_id for r in got.collect()} == set(range(150))


def test_exact_with_many_owners(spark, monkeypatch):
    monkeypatch.setattr(E, "OWNER_MARKS", 3)
    rows = [(i, f"text {i % 300}") for i in range(700)]
    for bits in (10, E.BITS):
        assert {r.doc_id for r in E.exact_dedup(docs(spark, rows), bits=bits).collect()} == set(range(300))


def test_exact_over_files_in_pieces(spark, tmp_path):
    rows = [(i, f"text {i % 60} " + "y" * 2000) for i in range(600)]
    docs(spark, rows).repartition(5).write.parquet(str(tmp_path / "d"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        got = E.exact_dedup(spark.read.parquet(str(tmp_path / "d")))
        assert {r.doc_id for r in got.collect()} == set(range(60))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_exact_oracle(spark, oracle):
    names, rows = oracle(E.ORACLES["op1_exact_dedup"], SF)
    got = E.op1_exact_dedup(spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def brute(sigs, has, radius):
    d = np.bitwise_count(sigs[:, None, :] ^ sigs[None, :, :]).sum(axis=2)
    return {(i, j) for i in range(len(sigs)) for j in range(i) if has[i] and has[j] and d[i, j] <= radius}


def test_bk_trees_find_all():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    sigs = base[rng.integers(0, 40, 500)]
    for _ in range(12):
        sigs[np.arange(500), rng.integers(0, 2, 500)] ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    shard = np.sort(rng.integers(0, 5, 500))
    for radius in (0, 3, 22, 128):
        got = {(int(a), int(b)) for x, y in N.bk_search(shard, sigs, radius, 64) for a, b in zip(x, y)}
        assert got == {(i, j) for i, j in brute(sigs, np.ones(500, bool), radius) if shard[i] == shard[j]}
    root, span, children, edge = N.bk_forest(shard, sigs)
    assert sorted(children) == [i for i in range(500) if root[i] != i]
    for v in range(500):
        mine = children[span[v, 0] : span[v, 1]]
        assert len(set(edge[mine])) == len(mine)


def test_signatures():
    texts = ["One two THREE", "three, two; one!", None, "", " \n", "!!", "日本語の文章はスペースがありません、とても長い一文です", "a b"]
    s, has = N.signatures(pa.array(texts))
    assert has.tolist() == [True, True, False, False, False, False, True, True] and (s[0] == s[1]).all()
    short = N.signatures(pa.array(["Of the thing", "In the thing", "The thing is in it", "Extraordinarily.", "An extraordinarily"]))[0]
    assert min(np.bitwise_count(short[i] ^ short[j]).sum() for i in range(5) for j in range(i)) > N.RADIUS
    unspaced = N.signatures(pa.array(["今日は天気がとても良いです", "今日は天気がとても良いで", "明後日なら雨が降るかもしれない"]))[0]
    assert np.bitwise_count(unspaced[0] ^ unspaced[1]).sum() < np.bitwise_count(unspaced[0] ^ unspaced[2]).sum() - 10
    again, _ = N.signatures(pa.array(texts[6:]))
    assert (again == s[6:]).all()


def test_shard_plan():
    assert N.shard_plan(0)[1] >= 1
    for n in (10**3, 10**6, 10**9):
        k, tables = N.shard_plan(n)
        assert N.SHARD / 2 <= n / 2**k <= N.SHARD or k == 8
        assert 1 - (1 - (1 - N.DESIGN / N.BITS) ** k) ** tables >= N.RECALL


def test_pairs_at_the_radius_meet():
    for n in (10**4, 10**6, 10**7, 10**8, 10**9):
        k, tables = N.shard_plan(n)
        apart = 1.0
        for i in range(k):
            apart *= (N.BITS - N.RADIUS - i) / (N.BITS - i)
        assert 1 - (1 - apart) ** tables >= N.RECALL
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 63, (2000, 2), dtype=np.uint64)
    b = a.copy()
    for row in b:
        for place in rng.choice(N.BITS, N.RADIUS, replace=False):
            row[place >> 6] ^= np.uint64(1) << np.uint64(place & 63)
    keys = np.array([N._keys(np.concatenate([a, b]), place) for place in N._places(*N.shard_plan(10**6))])
    assert (keys[:, :2000] == keys[:, 2000:]).any(axis=0).mean() > 0.93


def test_shards_arrive_whole(spark):
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    sigs[1500:] = sigs[:1500] ^ (np.uint64(1) << rng.integers(0, 64, (1500, 2), dtype=np.uint64))  # a distance of two
    df = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sigs], "sig binary")
    place = {s.tobytes(): i for i, s in enumerate(sigs)}
    got = {tuple(sorted((place[bytes(r.a)], place[bytes(r.b)]))) for r in N.near_pairs(df, 2).collect()}
    assert len(got) >= 1450 and all(j == i + 1500 for i, j in got)


def test_what_trees_visit():
    """At the radius in use a tree passes over little of a shard; at a small one, over most."""
    rng = np.random.default_rng(6)
    sigs = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    shard = np.zeros(len(sigs), np.int64)
    share = {}
    real = N._distance
    try:
        for radius in (3, 10, N.RADIUS):
            seen = []
            N._distance = lambda a, b: seen.append(len(a)) or real(a, b)  # noqa: B023
            list(N.bk_search(shard, sigs, radius))
            share[radius] = sum(seen) / len(sigs) ** 2
    finally:
        N._distance = real
    assert share[3] < 0.2 < share[10] < 0.75 and share[N.RADIUS] < 1.01


def test_a_large_group_of_equal_texts(spark):
    n = 100000
    df = spark.range(n).selectExpr("id + 5 as doc_id", "'the very same words are in all of these' as text", "'en' as lang", "'s' as source", "1L as n_chars")
    assert [r.doc_id for r in N.near_dedup(df).collect()] == [5]


def near(text, rng, share):
    return " ".join(rng.choice(["instead", "changed", "another"]) + str(rng.randint(0, 99)) if rng.random() < share else w for w in text.split())


def test_near_recall_and_precision(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    plain = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(plain)]
    copies = {1000 + i: i for i in range(100)}
    rows += [(c, near(plain[i], rng, 0.03)) for c, i in copies.items()]
    got = {r.doc_id for r in N.near_dedup(docs(spark, rows)).collect()}
    assert set(range(150)) <= got and len(got & set(copies)) <= 5


def test_near_pairs_against_brute_force(spark):
    t = spark.read.parquet(SF + "/documents.parquet").toPandas()
    s, has = N.signatures(pa.array(t.text))
    want = brute(s, has, N.RADIUS)
    label = list(range(len(s)))
    for i, j in sorted(want):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    keep = {min(t.doc_id[k] for k in range(len(s)) if label[k] == g) for g in set(label)}
    got = {r.doc_id for r in N.op9_simhash_near_dedup(spark, SF).collect()}
    assert keep <= got and len(got - keep) <= 0.1 * (len(s) - len(keep))


def test_near_edges(spark):
    long = " ".join(f"word{i}" for i in range(40000))
    same = "several words that are the very same in every one"
    rows = [(4, same), (2, same), (None, same), (2, same), (9, None), (10, None), (11, ""), (12, "..."), (13, "other things altogether are told here"), (None, "nameless lines stand alone somewhere"), (None, "nameless lines stand alone somewhere"), (30, long), (31, long + " end")]
    got = N.near_dedup(docs(spark, rows, ", near_mark int, least string", (1, "x")))
    assert sorted(((r.doc_id, (r.text or "")[:8]) for r in got.collect()), key=repr) == sorted([(2, "several "), (9, ""), (10, ""), (11, ""), (12, "..."), (13, "other th"), (None, "nameless"), (30, "word0 wo")], key=repr)
    assert got.columns[-2:] == ["near_mark", "least"]
    assert N.near_dedup(docs(spark, [])).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {tuple(r) for r in N.components(edges, 0).collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("y", "x")}
    n = 60
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)], "a string, b string")
    assert N.components(chain, 0).where(F.col("least") == "000").count() == n
