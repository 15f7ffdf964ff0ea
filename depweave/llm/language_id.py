"""Language identification with a string kernel, landmarks and ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, cols, fresh, give_back, load

#: At most so many labelled rows of a language are fitted on; it bounds the
#: driver's memory together with MOST_LANGUAGES and SAMPLE_CHARS.
SAMPLE_ROWS = 300
#: The commonest languages so many are told apart; a label beyond isn't predicted.
MOST_LANGUAGES = 200
#: Of a sampled text so many characters are fitted on: all of a text no
#: longer, else PIECES runs spread evenly over it. Scoring reads all.
SAMPLE_CHARS, PIECES = 4000, 16
LANDMARKS = 256
RIDGE = 1e-3
ORDERS = (1, 2, 3)
#: A document is rejected if it is less familiar than labelled texts of its
#: language and size are. Unfamiliar may be SLACK times what is at this
#: quantile of theirs, ODD at least, and the grams of one odd letter.
REJECT, SLACK, ODD = 0.02, 3, 0.15
#: Sizes, as powers of two of grams, for which there are cuts.
SIZES = 16
#: Symbols: boundary, letter in no labelled text, and each letter of those; Unicode has fewer letters than that.
ALPHABET = 1 << 18
#: Grams of more than one symbol are hashed to 2**SLOT_BITS places (up to FEW languages) or 2**MANY_SLOT_BITS.
SLOT_BITS, MANY_SLOT_BITS, FEW = 20, 18, 50
SLICE_CHARS = 1 << 20


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The code points of all letters, and of each its lower case (itself, if that is several characters)."""
    every = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    return np.array([ord(c) for c in every]), np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every])


class Lookup:
    """The place in the dictionary of each gram by its number: of single symbols exactly, of others by a hash."""

    def __init__(self, places: np.ndarray, symbols: int, bits: int):
        self.places, self.symbols, self.bits = places, symbols, bits

    def slots(self, code: np.ndarray, order: int) -> np.ndarray:
        if order == 1:
            return code
        x = code.astype(np.uint64)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64) + self.symbols

    def __getitem__(self, code: int) -> int:
        return int(self.places[self.slots(np.array([code]), 1 if code < ALPHABET else 2)[0]])


class Kernel:
    """What scoring needs: symbols of characters, grams of the dictionary, and weights."""

    def __init__(self, symbols: np.ndarray, lookup: Lookup, weights: np.ndarray, languages: list[str], bias: np.ndarray | float = 0.0):
        self.symbols, self.lookup, self.weights, self.languages, self.bias = symbols, lookup, weights, languages, bias
        self.width = weights.shape[0]
        spoken = lookup.places[2 : lookup.symbols]
        self.letters = spoken[spoken < self.width]
        #: the rows that are landmarks
        self.chosen: list[int] = []
        #: (languages, width): which grams a language's landmarks have; (languages, SIZES): its cuts
        self.own = np.ones((len(languages), self.width), bool)
        self.cuts = np.zeros((len(languages), SIZES))

    def presence(self, texts: pa.Array) -> np.ndarray:
        """(n, width) float32: which grams of the dictionary each text contains."""
        return self._read(texts)[0]

    def _read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Presence, and of how many grams of the highest order, how many of them in the dictionary, each text consists."""
        n = len(texts)
        held = np.zeros((n, self.width + 1), np.float32)
        total, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
        points, owner, left = _points(texts)
        flat = held.reshape(-1)
        for at in range(0, len(points), SLICE_CHARS):
            end = min(len(points), at + SLICE_CHARS)
            codes = self.symbols[np.minimum(points[at : end + max(ORDERS) - 1], len(self.symbols) - 1)].astype(np.int64)
            row = owner[at:end] * (self.width + 1)
            for order, code in _grams(codes, end - at):
                place = self.lookup.places[self.lookup.slots(code, order)].astype(np.int64)
                place[left[at:end][: len(place)] < order] = self.width
                flat[row[: len(place)] + place] = 1
                if order == max(ORDERS):
                    whole = (left[at:end][: len(place)] >= order) & (code != code_of_none(order))
                    who = owner[at:end][: len(place)]
                    total += np.bincount(who[whole], minlength=n)
                    known += np.bincount(who[whole & (place < self.width)], minlength=n)
        return held[:, : self.width], total, known

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n, languages) regression outputs, and whether a text has any letter that a labelled text has."""
        return self._scores(self.presence(texts))

    def _scores(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt(np.maximum(b.sum(axis=1), 1))[:, None]
        return (b @ self.weights) / norm + self.bias, b[:, self.letters].any(axis=1)

    def familiarity(self, texts: pa.Array, language: np.ndarray, read: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How well each text's grams are known for its ``language`` (a number), and its size class.

        That is the share of the text's grams that any landmark has, times
        the share of those present that the language's own landmarks have.
        """
        b, total, known = read or self._read(texts)
        own = np.einsum("ij,ij->i", b, self.own[language]) / np.maximum(b.sum(axis=1), 1)
        return np.where(total > 0, known / np.maximum(total, 1), 1.0) * own, np.minimum(np.log2(np.maximum(total, 1)), SIZES - 1)

    def classify(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the number of its language, the score, whether it has a known letter and whether it is familiar enough."""
        read = self._read(texts)
        s, has = self._scores(read[0])
        top = s.argmax(axis=1)
        share, size = self.familiarity(texts, top, read)
        low = np.floor(size).astype(np.int64)
        high = np.minimum(low + 1, SIZES - 1)
        cut = self.cuts[top, low] + (size - low) * (self.cuts[top, high] - self.cuts[top, low])
        return top, s[np.arange(len(top)), top], has, has & (share >= cut)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts on end; of each, its text and how many of the text are left from it on."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = "".join(t or "" for t in texts.to_pylist())
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    return points, owner, left


def _grams(codes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each order, the numbers of the grams that begin at the first ``n`` symbols."""
    base, code = 0, codes
    for order in ORDERS:
        if order > 1:
            if len(codes) < order:
                return
            code = code[: len(codes) - order + 1] * ALPHABET + codes[order - 1 :]
        yield order, code[:n] + base
        base += ALPHABET**order


def code_of_none(order: int) -> int:
    """The number of the gram of nothing but boundaries."""
    return sum(ALPHABET**o for o in ORDERS if o < order)


def _cuts(rows: list[tuple[str, str]], chosen: set[int], kernel: Kernel, others: Kernel, reject: float, seed: int) -> np.ndarray:
    """The least familiarity of each language and size class, from pieces of the labelled texts at all sizes.

    Pieces are held against landmarks other than their own text: ``others``
    knows only what at least two have, and serves for texts that are
    landmarks. A class without pieces has the cut of the next lower one, and
    a language of which nothing can be held out, 0.
    """
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(kernel.languages)}
    found: list[tuple[int, float, float]] = []
    for model, mine in ((others, True), (kernel, False)):
        pieces, owner = [], []
        for i, (lang, text) in enumerate(rows):
            if (i in chosen) == mine:
                for length in [1 << k for k in range(2, SIZES + 1) if 1 << k < len(text)] + [len(text)]:
                    at = int(rng.integers(0, len(text) - length + 1))
                    pieces.append(text[at : at + length])
                    owner.append(number[lang])
        for i in range(0, len(pieces), 64):
            share, size = model.familiarity(pa.array(pieces[i : i + 64]), np.array(owner[i : i + 64]))
            found += zip(owner[i : i + 64], share, size)
    out = np.zeros((len(kernel.languages), SIZES))
    if not found:
        return out
    who, share, size = (np.array(x) for x in zip(*found))
    size = np.round(size)
    for lang in range(len(out)):
        for k in range(SIZES):
            here = share[(who == lang) & (size == k)]
            if len(here):
                out[lang, k] = max(0.0, 1 - max(ODD, SLACK * (1 - np.quantile(here, reject))) - max(ORDERS) / (1 << k))
            elif k:
                out[lang, k] = out[lang, k - 1]
    return out


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 5, reject: float = REJECT) -> Kernel:
    """A classifier from (language, text) rows.

    The kernel of two texts is the number of grams (of 1 to 3 symbols, of
    those that any landmark has) present in both, over the geometric mean of
    the numbers present in each. Landmarks are drawn evenly over languages.
    With C the kernel among landmarks and K that of rows with landmarks, the
    Nystroem features are ``K C^-1/2``, and each language has a ridge
    regression on them against the rest. All of that is linear in the
    presence of grams, so it folds into one matrix: landmarks' presences
    times the dual weights. Every letter of the rows is a symbol of its own,
    whatever the script.

    One-versus-rest outputs of L languages sum to 2 - L for any text at all,
    so they tell languages apart but not text in a known one from other
    text. That is told by the text's familiarity, see :func:`_cuts`.
    """
    languages = sorted({lang for lang, _ in rows})
    point, lower = _letters()
    seen = np.unique([ord(c) for c in set().union(*(set(text) for _, text in rows)) if c.isalpha()]).astype(np.int64)
    seen = np.unique(lower[np.searchsorted(point, seen)])
    symbols = np.zeros(0x110000, np.int32)
    at = np.minimum(np.searchsorted(seen, lower), max(0, len(seen) - 1))
    symbols[point] = np.where(seen[at] == lower, at + 2, 1) if len(seen) else 1
    bits = SLOT_BITS if len(languages) <= FEW else MANY_SLOT_BITS
    full = len(seen) + 2 + (1 << bits)
    every = Kernel(symbols, Lookup(np.arange(full, dtype=np.int32), len(seen) + 2, bits), np.zeros((full, 1), np.float32), languages)
    rng = np.random.default_rng(seed)
    by = {lang: [i for i, r in enumerate(rows) if r[0] == lang] for lang in languages}
    share = max(1, landmarks // len(languages))
    chosen = [int(i) for lang in languages for i in rng.permutation(by[lang])[:share]]

    having = [np.flatnonzero(b) for i in chosen for b in every.presence(pa.array([rows[i][1]]))]
    there = np.zeros(full, bool)
    there[2 : len(seen) + 2] = True  # any letter of a labelled text is known, though no landmark has it
    for h in having:
        there[h] = True
    there[0] = False
    grams = np.flatnonzero(there)
    places = np.full(full, len(grams), np.int32)
    places[grams] = np.arange(len(grams))
    lookup = Lookup(places, len(seen) + 2, bits)
    marks = np.zeros((len(chosen), len(grams)), np.float32)
    for mark, h in zip(marks, having):
        mark[places[h[h > 0]]] = 1
    mark_language = np.array([languages.index(rows[i][0]) for i in chosen])
    times = np.stack([marks[mark_language == i].sum(axis=0) for i in range(len(languages))])
    marks /= np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    kernel = Kernel(symbols, lookup, np.zeros((len(grams), 1), np.float32), languages)
    texts = [t for _, t in rows]
    k = []
    for i in range(0, len(texts), 64):
        b = kernel.presence(pa.array(texts[i : i + 64]))
        k.append((b @ marks.T) / np.sqrt(np.maximum(b.sum(axis=1), 1))[:, None])
    k = np.concatenate(k).astype(np.float64)
    c = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(c)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    z = np.concatenate([k @ root, np.ones((len(k), 1))], 1)
    target = np.array([[1.0 if lang == one else -1.0 for one in languages] for lang, _ in rows])
    # languages weigh alike whatever their numbers of rows
    count = {lang: len(by[lang]) for lang in languages}
    w = np.array([1.0 / count[lang] for lang, _ in rows])[:, None] / len(languages)
    penalty = ridge / len(languages) * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(z.T @ (w * z) + penalty, z.T @ (w * target))
    model = Kernel(symbols, lookup, (marks.T @ (root @ beta[:-1])).astype(np.float32), languages, beta[-1].astype(np.float32))
    model.own, model.chosen = times > 0, chosen
    again = places.copy()
    again[grams[times.sum(axis=0) < 2]] = len(grams)
    others = Kernel(symbols, Lookup(again, lookup.symbols, bits), kernel.weights, languages)
    others.own = times > 1
    model.cuts = _cuts(rows, set(chosen), model, others, reject, seed)
    return model


def _spread_over(text: Column, chars: int) -> Column:
    """So many characters of a text: PIECES runs that begin at even distances, the last of which ends the text."""
    run = max(1, chars // PIECES)
    starts = [F.floor((F.length(text) - run) * i / (PIECES - 1)).cast("int") + 1 for i in range(PIECES)]
    pieces = F.concat_ws(" ", *(F.substring(text, start, F.lit(run)) for start in starts))
    return F.when(F.length(text) <= chars, text).otherwise(pieces)


def training_rows(docs: DataFrame, per_language: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language: those whose ids hash lowest.

    Of texts of more than ``sample_chars``, runs from all over are taken; the
    commonest ``most_languages`` languages count, ties going to the first by name.
    """
    labelled = docs.where(col("lang").isNotNull() & (F.length(F.trim(col("text"))) > 0))
    order = F.xxhash64(col("doc_id").cast("string"), F.lit(11))
    counts = docs.where(col("lang").isNotNull()).groupBy(col("lang").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return []
    # a share of the ids by hash, some four times what is needed, so that no text is sorted but these
    share = F.lit(1.0)
    for r in counts:
        share = F.when(col("lang") == r.lang, min(1.0, 4.0 * per_language / r["count"] + 1e-9)).otherwise(share)
    within = F.pmod(order, F.lit(1 << 20)) / float(1 << 20) < share
    few = labelled.where(within & col("lang").isin([r.lang for r in counts])).select(col("lang").alias("lang"), _spread_over(col("text").cast("string"), sample_chars).alias("text"), order.alias("o"))
    top = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))).where(F.col("r") <= per_language)
    return sorted((r.lang, r.text) for r in top.select("lang", "text").collect())


def identify(docs: DataFrame, reject: float = REJECT, per_language: int = SAMPLE_ROWS, language: str = "language", score: str = "language_score", accepted: str = "accepted", most_languages: int = MOST_LANGUAGES, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``docs`` with the language found, its score and whether it is accepted.

    The classifier is fitted on a bounded sample of rows whose ``lang`` is
    given: ``per_language`` of each, hashed from the ids, and of one longer
    than ``sample_chars`` runs of that length together from all over it. Only the ``most_languages`` with the most rows
    are told apart; raise it, at the cost of the driver's memory, for tables
    with more. All documents are
    then scored over their whole texts, in batches of matrix products. The
    language has the highest score, ties going to the first by name. A
    document is accepted if its grams are as familiar as those of labelled
    texts of that language and size, held against others than themselves:
    its unfamiliar share may be SLACK times that at their quantile
    ``reject``, ODD at least, and one odd letter more. So text in a language that no label
    names, and noise, are rejected, unless too short to tell.

    Defined results: null and empty texts, and texts without a letter that
    the labelled rows fitted on have, have a null language and score and aren't accepted; if no row has
    a ``lang``, that holds for all; null ids are hashed as such; repeated
    rows get equal results; extra columns pass through, but for those with
    the names of the three made. An empty table gives an empty one.
    """
    model = fit(rows, reject=reject) if (rows := training_rows(docs, per_language, most_languages, sample_chars)) else None
    own = [n for n in docs.columns if n.lower() not in (language.lower(), score.lower(), accepted.lower())]
    found = fresh(docs, "found")[0]
    out_type = pa.struct([("language", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("struct<language: string, score: double, accepted: boolean>")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.combine_chunks()
            languages, best, taken = [], [], []
            for a, b in slices(texts, rows=max(1, min(128, (1 << 24) // max(1, model.width)))):
                top, s, has, familiar = model.classify(texts.slice(a, b - a))
                languages.append(np.where(has, np.array(model.languages, object)[top], None))
                best.append(np.where(has, s, np.nan))
                taken.append(familiar)
            lang = np.concatenate(languages) if languages else np.zeros(0, object)
            value = np.concatenate(best) if best else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(value, pa.float64(), mask=np.isnan(value)), pa.array(np.concatenate(taken) if taken else np.zeros(0, bool))], fields=list(out_type))
        give_back()

    # else a filter on what is found would go below and have every text classified twice
    once = classify.asNondeterministic()
    if model is None:
        none = docs.select(*cols(own), F.lit(None).cast("string").alias(language), F.lit(None).cast("double").alias(score))
        return none.withColumn(accepted, F.lit(False))
    scored = docs.select(*cols(own), once(col("text").cast("string")).alias(found))
    return scored.select(
        *cols(own),
        F.col(found)["language"].alias(language),
        F.col(found)["score"].alias(score),
        F.coalesce(F.col(found)["accepted"], F.lit(False)).alias(accepted),
    )


def slices(texts: pa.Array, rows: int = 128, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows, of ``rows`` at most, and of ``chars`` but for single long texts."""
    held = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = held[at - 1] if at else 0
        end = int(min(at + rows, max(at + 1, np.searchsorted(held, base + chars, "right"))))
        yield at, end
        at = end


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents")).select("doc_id", "language", "language_score", "accepted")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
