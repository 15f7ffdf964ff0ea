import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depweave.llm import language_id as L
from depweave.llm import mixing as M
from depweave.llm import sharding as H

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, model):
    symbols = [int(model.symbols[min(ord(c), 0x10000)]) for c in text]
    out = set()
    base = 0
    for order in L.ORDERS:
        for i in range(len(symbols) - order + 1):
            code = 0
            for s in symbols[i : i + order]:
                code = code * L.ALPHABET + s
            if (place := int(model.lookup[base + code])) < model.width:
                out.add(place)
        base += L.ALPHABET**order
    return out


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(L.training_rows(spark.read.parquet(SF + "/documents.parquet")))


def test_scores_by_brute_force(model):
    texts = ["the cat sat", "Ünïcode ÀÉ", "", None, "a", "x" * 3000 + " y", "日本"]
    got, has = model.scores(pa.array(texts))
    for t, s, h in zip(texts, got, has):
        mine = grams(t or "", model)
        want = model.weights[sorted(mine)].sum(axis=0) / max(1, len(mine)) ** 0.5 + model.bias
        assert np.allclose(s, want, atol=1e-3) and h == any(g in set(model.letters.tolist()) for g in mine)


def test_fit_by_brute_force():
    """Kernel, Nystroem features and ridge regression from sets of grams, against the folded matrix."""
    rng = random.Random(12)
    letters = {"aa": "abcdeklmno", "bb": "defghklmnp", "cc": "ghijkqrstu"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6))) for _ in range(12))
    rows = [(lang, text(lang)) for lang in letters for _ in range(14 if lang == "aa" else 9)]
    model = L.fit(rows, landmarks=15)
    assert len(model.chosen) == 15 and Counter(rows[i][0] for i in model.chosen) == {"aa": 5, "bb": 5, "cc": 5}
    sets = [grams(t, model) for _, t in rows]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [sets[i] for i in model.chosen]
    c = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(c)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    features = lambda given: np.array([[kernel(a, b) for b in marks] for a in given]) @ root
    z = np.concatenate([features(sets), np.ones((len(rows), 1))], 1)
    count = Counter(lang for lang, _ in rows)
    beta = []
    for one in model.languages:  # one against the rest, each language weighing alike
        w = np.array([1 / count[lang] / 3 for lang, _ in rows])
        y = np.array([1.0 if lang == one else -1.0 for lang, _ in rows])
        penalty = np.diag([L.RIDGE / 3] * (z.shape[1] - 1) + [1e-9])
        beta.append(np.linalg.solve((z * w[:, None]).T @ z + penalty, (z * w[:, None]).T @ y))
    new = [text(lang) for lang in letters for _ in range(6)]
    want = np.concatenate([features([grams(t, model) for t in new]), np.ones((len(new), 1))], 1) @ np.array(beta).T
    got, _ = model.scores(pa.array(new))
    assert np.allclose(got, want, atol=2e-3) and (got.argmax(axis=1) == np.repeat([0, 1, 2], 6)).all()


def test_language_query(spark, model):
    got = {r.doc_id: r for r in L.op3_language_id(spark, SF).collect()}
    docs = spark.read.parquet(SF + "/documents.parquet").toPandas()
    top, score, has, accepted = model.classify(pa.array(docs.text))
    assert has.all() and set(got) == set(docs.doc_id)
    for i, t, s, a in zip(docs.doc_id, top, score, accepted):
        assert (got[i].language, got[i].accepted) == (model.languages[t], a) and abs(got[i].language_score - s) < 1e-4


def test_whole_texts_count(model):
    text = "der die und nicht " * 40 + "the and of with " * 80000
    assert len(text) > L.SLICE_CHARS
    assert (model.presence(pa.array([text]))[0] == model.presence(pa.array(["der die und nicht " * 40 + "the and of with " * 5]))[0]).all()


def test_held_out_accuracy(spark, model):
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200").toPandas()
    s, has = model.scores(pa.array(held.text))
    assert (np.array(model.languages)[s.argmax(axis=1)] == held.lang).mean() > 0.97


def test_language_edges(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12345 %%%", None, "s", 9), (None, "the and of with is was by it", "en", "s", 5), (5, "der die und nicht ist das von", "de", "s", 5), (6, "Привет мир", None, None, None)]
    rows += [(10 + i, "the of and that is with by from was", "en", "s", 30) for i in range(4)] + [(20 + i, "und der die das ist nicht von mit", "de", "s", 30) for i in range(4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", found string, score int")
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert len(got) == len({r[0] for r in rows}) and got[5].language == "de" and got[None].language == "en" and got[5].found == "x"
    for i in (1, 2, 3, 6):
        assert (got[i].language, got[i].language_score, got[i].accepted) == (None, None, False)
    none = L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.accepted for r in none} == {False}
    assert L.identify(df.where("false")).collect() == []


def test_unlabelled_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"
    noise = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400))
    odd = spark.createDataFrame([(-1, finnish, None, "s", 0), (-2, noise, None, "s", 0), (-3, "asdf jklö qwer zxcv " * 9, None, "s", 0)], DOCS)
    for one in ("es", "fr", "de"):
        known = F.when(F.col("lang") != one, F.col("lang"))
        got = L.identify(docs.withColumn("lang", known).unionByName(odd)).select("doc_id", "accepted").toPandas()
        long = docs.where("n_chars >= 60").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
        assert not got.accepted[got.doc_id < 0].any()
        assert long.accepted[long.lang == one].mean() < 0.05 and long.accepted[long.lang != one].mean() > 0.98
    got = L.identify(docs.unionByName(odd)).select("doc_id", "accepted").toPandas()
    assert not got.accepted[got.doc_id < 0].any() and got.accepted[got.doc_id >= 0].mean() > 0.99


def test_letters_of_all_scripts_count(spark):
    rng = random.Random(4)
    scripts = {"en": "abcdefghijklmnopqrstuvwxyz", "cs": "aábcčdďeéěfghiíjklmnňoóprřsštťuúůvyýzž", "vi": "aăâbcdđeêghiklmnoôơpqrstuưvxyạảấầẩẫậắằẳẵặẹẻẽếềểễệịỉĩọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 800))), "gothic": "".join(map(chr, range(0x10330, 0x10348)))}
    words = {lang: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(120)] for lang, a in scripts.items()}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(80))
    rows = [(lang, text(lang)) for lang in scripts for _ in range(150 if lang in ("en", "cs", "vi") else 6)]
    model = L.fit(rows)
    new = [(lang, text(lang)) for lang in scripts for _ in range(10)] + [(lang, words[lang][0]) for lang in ("ru", "el", "zh", "gothic")]
    top, _, has, accepted = model.classify(pa.array([t for _, t in new]))
    assert has.all() and accepted.all() and [model.languages[i] for i in top] == [lang for lang, _ in new]
    strange = model.classify(pa.array(["ქართული ენა", "한국어 문장"]))
    assert not strange[2].any() and not strange[3].any()


def test_samples_reach_past_a_foreign_head(spark):
    head = "all rights reserved by the holders of this text and its parts " * 100
    german = "und der die das ist nicht von mit einem wort über alle dinge gesprochen " * 100
    rows = [(i, head + german, "de", "s", 1) for i in range(5)] + [(10 + i, head + "the rest of it is told here in plain words as before " * 100, "en", "s", 1) for i in range(5)]
    rows += [(20, german[:300], None, "s", 1)] + [(30 + i, "um dois três quatro cinco", "pt", "s", 1) for i in range(2)]
    df = spark.createDataFrame(rows, DOCS)
    sample = L.training_rows(df)
    assert all("gesprochen" in t for lang, t in sample if lang == "de") and max(len(t) for _, t in sample) <= L.SAMPLE_CHARS + L.PIECES
    whole = dict(L.training_rows(df, sample_chars=10**6))
    assert len(whole["de"]) == len(head + german)
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert (got[20].language, got[20].accepted) == ("de", True) and got[30].language == "pt"
    assert {lang for lang, _ in L.training_rows(df, most_languages=2)} == {"de", "en"}


def test_sample_is_bounded(spark):
    got = L.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 20)
    assert set(Counter(lang for lang, _ in got).values()) == {20}


def walk2d(bits):
    """Cells of a plane in Hilbert order, by the rotations told in textbooks."""
    n = 1 << bits
    out = []
    for d in range(n * n):
        x = y = 0
        t, s = d, 1
        while s < n:
            rx = 1 & (t // 2)
            ry = 1 & (t ^ rx)
            if ry == 0:
                if rx == 1:
                    x, y = s - 1 - x, s - 1 - y
                x, y = y, x
            x, y = x + s * rx, y + s * ry
            t //= 4
            s *= 2
        out.append((x, y))
    return out


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_is_a_path_through_all_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = H.hilbert_index(cells, bits)
    assert sorted(index) == list(range(1 << bits * dims))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_hilbert_in_the_plane():
    path = walk2d(3)
    index = H.hilbert_index(np.array(path), 3)
    turned = H.hilbert_index(np.array(path)[:, ::-1], 3)
    assert (index == np.arange(64)).all() or (turned == np.arange(64)).all()


def test_shards_prune(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = H.hilbert_shards(df, shard_chars=100000)
    got.write.parquet(str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).withColumn("f", F.input_file_name())
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in df.select("doc_id").collect())
    per = back.groupBy("shard_id").agg(F.countDistinct("f").alias("files"), F.min("curve_index").alias("lo"), F.max("curve_index").alias("hi"), F.sum("n_chars").alias("n")).orderBy("shard_id").collect()
    assert {r.files for r in per} == {1} and len(per) > 15 and max(r.n for r in per) <= 1.6 * 100000
    assert all(a.hi <= b.lo for a, b in zip(per, per[1:]))
    touched = lambda by: back.groupBy("f").agg(F.min(by).alias("a"), F.max(by).alias("b"))
    small = touched("n_chars").where("a <= 300").count()
    assert small < 0.8 * len(per)


def test_shard_edges(spark):
    rows = [(i, "t", None, None, None) for i in range(5)] + [(9, None, "en", "s", -5), (None, "", "de", "s", 10**6), (9, None, "en", "s", -5)]
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], DOCS + ", shard_id string, cell_amount int")
    got = H.hilbert_shards(df, shard_chars=1000).collect()
    assert len(got) == len(rows) and len({r.shard_id for r in got if r.doc_id == 9}) == 1 and {r.cell_amount for r in got} == {3}
    assert H.hilbert_shards(df.where("false")).collect() == []
    hot = spark.createDataFrame([(i, "t", "en", "s", 100) for i in range(2000)], DOCS)
    sizes = Counter(r.shard_id for r in H.hilbert_shards(hot, shard_chars=10000).collect())
    assert len(sizes) >= 19 and max(sizes.values()) < 200


def test_texts_are_cut_by_whole_values(spark):
    rng = random.Random(9)
    urls = [f"https://www.{rng.choice(['alpha', 'beta', 'gamma', 'delta', 'omega', 'sigma', 'tau'])}.example.com/archive/{rng.randint(0, 10**9)}" for _ in range(2000)]
    for more in ([], ["", "~", None, None]):
        rows = [(i, "t", None, u, 1) for i, u in enumerate([*urls, *more])]
        got = H.hilbert_shards(spark.createDataFrame(rows, DOCS), ("source",), bits=5).collect()
        cells = Counter(r.curve_index for r in got)
        assert len(cells) == 32 and max(cells.values()) < 1.2 * len(rows) / 32 + 5
        by_value = sorted((r.source or "", r.curve_index) for r in got if r.source is not None)
        assert [c for _, c in by_value] == sorted(c for _, c in by_value)
    assert H.text_cuts(spark.createDataFrame([("a",)] * 90 + [("b",)] * 5 + [("c",)] * 5, "v string"), 4) == ["b"]
    assert H.text_cuts(spark.createDataFrame([], "v string"), 4) == []
    assert H.text_cuts(spark.createDataFrame([("a",)] * 40 + [("b",)] * 40 + [("c",)] * 20, "v string"), 4) == ["b", "c"]


def test_sharding_query(spark):
    """Every document once, in shards that are runs of the curve no longer than asked."""
    got = H.op4_hilbert_sharding(spark, SF).toPandas()
    docs = spark.read.parquet(SF + "/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and list(got.columns[:-2]) == list(docs.columns)
    per = got.groupby("shard_id").agg(low=("curve_index", "min"), high=("curve_index", "max"), n=("n_chars", "sum")).sort_index()
    assert (per.high.to_numpy()[:-1] <= per.low.to_numpy()[1:]).all() and per.n.max() <= 1.13 * H.SHARD_CHARS
    whole = docs.merge(got[["doc_id", "curve_index"]], on="doc_id")
    for lang, source in set(zip(whole.lang, whole.source)):  # in a cell of two dimensions the third is in steps
        some = whole[(whole.lang == lang) & (whole.source == source)]
        assert some.groupby("curve_index").n_chars.agg(lambda x: x.max() - x.min()).max() <= docs.n_chars.max() / 4


def test_the_table_of_cells_is_bounded(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = {r.doc_id: r.curve_index for r in H.hilbert_shards(df, shard_chars=100000).collect()}
    monkeypatch.setattr(H, "MOST_CELLS", 60)
    few = {r.doc_id: r.curve_index for r in H.hilbert_shards(df, shard_chars=100000).collect()}
    assert 10 < len(set(few.values())) <= 60 < len(set(whole.values())) and few.keys() == whole.keys()
    assert len({(whole[i] >> 1).bit_length() - few[i].bit_length() for i in few if few[i] > 3} - set(range(0, 40))) == 0
    order = sorted(whole, key=whole.get)
    assert [few[i] for i in order] == sorted(few.values())
    wide = H.hilbert_shards(df, shard_chars=1000, most_shards=7)
    assert wide.select("shard_id").distinct().count() in (7, 8) and wide.rdd.getNumPartitions() <= 8


def expected(rows, weights=None):
    tokens, out = Counter(), Counter()
    for _, t, _, s, _ in rows:
        tokens[s] += len((t or "").split())
    w = {s: (n**0.5 if weights is None else weights.get(s, 0)) for s, n in tokens.items()}
    return {s: (1.0 if not n else w[s] / sum(w.values()) * sum(tokens.values()) / n) for s, n in tokens.items()}


def test_mixing_rates(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 9), "en", rng.choice(["a"] * 8 + ["b", None]), 1) for i in range(1500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", rate int")
    for weights in (None, {"a": 1, "b": 2, None: 1}):
        rates = expected(rows, weights)
        got = M.mix(df, weights, copy_column="copy").collect()
        times = Counter(r.doc_id for r in got)
        for i, *_, s, _ in rows:
            assert times[i] in (int(rates[s]), int(rates[s]) + 1)
        for s, rate in rates.items():
            mine = [times[r[0]] for r in rows if r[3] == s]
            assert abs(sum(mine) / len(mine) - rate) < 4 * (0.25 / len(mine)) ** 0.5
        assert {(r.doc_id, r.copy) for r in got} == {(i, c) for i, n in times.items() for c in range(n)}
        assert sorted(map(tuple, M.mix(df, weights, copy_column="copy").collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mixing_edges(spark):
    rows = [(1, None, "en", "empty", 0), (2, "", "en", "empty", 0), (None, "a b", "en", "x", 3), (None, "a b", "en", "x", 3), (5, "c " * 50000, "en", "x", 3)]
    df = spark.createDataFrame(rows, DOCS)
    got = M.mix(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect() if r.source == "empty") == [1, 2]
    assert M.mix(df, {"x": 1.0}).where("source = 'x'").count() == M.mix(df, {"x": 1.0}).count() == 3
    assert M.mix(df.where("false")).collect() == [] == M.mix(df.where("false"), {"x": 1}).collect()
    assert M.mix(df, {}).collect() == [] == M.mix(df, {"nobody": 2.0}).collect() == M.mix(df, {"x": 0}).collect()
    assert sorted(r.doc_id for r in M.mix(df, {"empty": 1.0}).collect()) == [1, 2]
    for wrong in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="not negative"):
            M.mix(df, {"x": wrong})


def test_mixing_repeats_and_thins(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", s, 1) for i, s in enumerate(["a"] * 900 + ["b"] * 60 + ["c"] * 40)]
    df = spark.createDataFrame(rows, DOCS)
    rates = expected(rows, {"a": 1, "b": 1, "c": 2})
    assert rates["a"] < 0.4 and rates["b"] > 3 and rates["c"] > 9
    times = Counter(r.doc_id for r in M.mix(df, {"a": 1, "b": 1, "c": 2}).collect())
    for i, t, _, s, _ in rows:
        draw = int(hashlib.md5(f"{i}:{M.SEED}".encode()).hexdigest()[:8], 16) / 2**32
        assert times[i] == int(rates[s]) + (draw < rates[s] % 1)
    plain, more = (Counter(r.source for r in M.mix(df, emphasis=e).collect()) for e in (None, {"c": 8.0, "a": 0.0}))
    assert more["c"] > 2 * plain["c"] and more["a"] == 0 < plain["a"]


def test_mixing_oracle(spark, oracle):
    names, rows = oracle(M.ORACLES["op7_source_mixing"], SF)
    assert sorted(map(tuple, M.op7_source_mixing(spark, SF).select(*names).collect())) == sorted(rows)
