"""Language-model scores: the likelihood of a document over its subword lattice."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cols, fresh, give_back, load
from .language_id import slices
from .subword import LOCKSTEP, MODEL, SPACE, Vocabulary, vocabulary

#: The model file's distribution counts as so many pieces beside the corpus.
PRIOR = 1000.0
SLICE_CHARS = 4 << 20


def file_log_probabilities(vocab: Vocabulary) -> np.ndarray:
    """Log probabilities of pieces from the scores in the model file.

    Scores of a unigram model are log probabilities already. In a BPE model
    they are ranks counted down from 0, and a piece weighs 1 / (1 + rank), as
    by Zipf's law. Byte pieces, which have no score, weigh what the least
    piece does. Others have none.
    """
    plain = np.isin(vocab.kind, (1, 4))
    value = np.full(len(vocab.pieces), -np.inf)
    value[plain] = vocab.score[plain] if vocab.unigram else -np.log1p(np.abs(vocab.score[plain]))
    if vocab.byte_ids is not None:
        value[vocab.byte_ids] = value[plain].min()
    return value - np.logaddexp.reduce(value)


class Lattice:
    """Forward and backward sums over all segmentations of words."""

    def __init__(self, vocab: Vocabulary, log_p: np.ndarray, more: np.ndarray | None = None):
        self.vocab, self.log_p = vocab, log_p
        self.floor = float(log_p[np.isfinite(log_p)].min())
        #: another distribution that :meth:`forward` sums beside, over the same edges
        self.beside = Lattice(vocab, more) if more is not None else None

    def spelled(self, points: np.ndarray) -> np.ndarray:
        """Log probability of characters without a piece, as bytes."""
        if self.vocab.byte_ids is None:
            return np.full(len(points), self.floor)
        each, where = np.unique(points, return_inverse=True)
        return np.array([self.log_p[self.vocab.byte_ids[list(chr(p).encode("utf-8", "replace"))]].sum() for p in each])[where]

    def edge_values(self, i: int, rows: np.ndarray, piece: np.ndarray, points: np.ndarray) -> np.ndarray:
        return self.log_p[piece] if piece[0] >= 0 else self.spelled(points[i, rows])

    def forward(self, words: list[str]) -> np.ndarray:
        """(distributions, words): log of the summed probability of all segmentations of each word, a space before it included."""
        each = [self, self.beside] if self.beside else [self]
        out = np.zeros((len(each), len(words)))
        for pick, size, points in self.vocab._lockstep(words):
            alphas = [np.full((len(points) + 1, len(pick)), -np.inf) for _ in each]
            for alpha in alphas:
                alpha[0] = 0
            for i, k, rows, piece in self.vocab.edges(size, points):
                for one, alpha in zip(each, alphas):
                    value = alpha[i][rows] + one.edge_values(i, rows, piece, points)
                    alpha[i + k][rows] = np.logaddexp(alpha[i + k][rows], value)
            for row, alpha in zip(out, alphas):
                row[pick] = alpha[size, np.arange(len(pick))]
        for i, w in enumerate(words):
            if len(w) + 1 > LOCKSTEP:
                for row, one in zip(out, each):
                    row[i] = one.stream(SPACE + w.replace(" ", SPACE))
        return out

    def _begin(self, text: str) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(place, [(length, piece or -1, log probability)]) of one text."""
        v = self.vocab
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = v.symbol[points].tolist()
        for i in range(len(points)):
            node, found = 0, []
            for k in range(min(v.longest, len(points) - i)):
                slot = int(v.base[node]) + symbols[i + k]
                if v.owner[slot] != node:
                    break
                node = int(v.child[slot])
                if (p := int(v.piece_of[node])) >= 0:
                    found.append((k + 1, p, float(self.log_p[p])))
            if not found or found[0][0] > 1:
                found.append((1, -1, float(self.spelled(points[i : i + 1])[0])))
            yield i, found

    def stream(self, text: str) -> float:
        """The forward sum of one text of any length, with a window of the longest piece."""
        window = [0.0] + [-math.inf] * self.vocab.longest
        for _, found in self._begin(text):
            for k, _, value in found:
                window[k] = _add(window[k], window[0] + value)
            window = window[1:] + [-math.inf]
        return window[0]

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words that occur ``times``, all segmentations weighed by their probability."""
        counts = np.zeros(len(self.log_p))
        for pick, size, points in self.vocab._lockstep(words):
            n = len(pick)
            alpha = np.full((len(points) + 1, n), -np.inf)
            alpha[0] = 0
            edges = []
            for i, k, rows, piece in self.vocab.edges(size, points):
                value = self.edge_values(i, rows, piece, points)
                alpha[i + k][rows] = np.logaddexp(alpha[i + k][rows], alpha[i][rows] + value)
                edges.append((i, k, rows, piece, value))
            beta = np.full((len(points) + 1, n), -np.inf)
            beta[size, np.arange(n)] = 0
            whole = alpha[size, np.arange(n)]
            for i, k, rows, piece, value in reversed(edges):
                ahead = value + beta[i + k][rows]
                beta[i][rows] = np.logaddexp(beta[i][rows], ahead)
                if piece[0] >= 0:
                    with np.errstate(under="ignore"):
                        share = np.exp(alpha[i][rows] + ahead - whole[rows]) * times[pick[rows]]
                    counts += np.bincount(piece, share, len(counts))
                else:
                    self._count_bytes(counts, points[i, rows], np.exp(alpha[i][rows] + ahead - whole[rows]) * times[pick[rows]])
        for j, w in enumerate(words):
            if len(w) + 1 > LOCKSTEP:
                self._expected_long(SPACE + w.replace(" ", SPACE), float(times[j]), counts)
        return counts

    def _count_bytes(self, counts: np.ndarray, points: np.ndarray, share: np.ndarray) -> None:
        if self.vocab.byte_ids is not None:
            for p in np.unique(points):
                np.add.at(counts, self.vocab.byte_ids[list(chr(p).encode("utf-8", "replace"))], share[points == p].sum())

    def _expected_long(self, text: str, times: float, counts: np.ndarray) -> None:
        edges = [found for _, found in self._begin(text)]
        n = len(edges)
        alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for i, found in enumerate(edges):
            for k, _, value in found:
                alpha[i + k] = _add(alpha[i + k], alpha[i] + value)
        for i in range(n - 1, -1, -1):
            for k, piece, value in edges[i]:
                beta[i] = _add(beta[i], value + beta[i + k])
                share = times * math.exp(min(0.0, alpha[i] + value + beta[i + k] - alpha[n]))
                if piece >= 0:
                    counts[piece] += share
                else:
                    self._count_bytes(counts, np.array([ord(text[i])]), np.array([share]))


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def word_counts(docs: DataFrame, held) -> DataFrame:
    """(word, n) over all documents: the segments that the lattice falls into, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held.value
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts, 1 << 20, SLICE_CHARS):
                _, coded = vocab.segments(texts.slice(a, b - a))
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select(col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_unigram(docs: DataFrame, model: str = MODEL, prior: float = PRIOR) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces in ``docs``.

    The words of all documents are counted. The probabilities that the model
    file gives weigh each word's segmentations, and so its pieces: one step
    of expectation and maximisation, with the file's distribution as a prior.
    """
    spark = docs.sparkSession
    vocab = vocabulary(model)
    before = file_log_probabilities(vocab)
    held = spark.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(held.value, before)
        total = np.zeros(len(before))
        for batch in batches:
            words = batch.column(0).to_pylist()
            total += lattice.expected(words, batch.column(1).to_numpy().astype(float))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "n"])

    found = word_counts(docs, held).mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece at most
    counts = np.exp(before) * prior
    for r in found:
        counts[r.piece] += r.n
    with np.errstate(divide="ignore"):
        return np.log(counts / counts.sum())


def lm_score(docs: DataFrame, model: str = MODEL, log_prob: str = "log_prob", bits: str = "bits_per_char", corpus: bool = False, prior: float = PRIOR, corpus_log_prob: str = "corpus_log_prob", corpus_bits: str = "corpus_bits_per_char") -> DataFrame:
    """``docs`` with the natural log of each text's probability, and the bits it takes a character.

    The probability is the sum over all segmentations of a text into pieces
    of the product of the pieces' probabilities, by forward recursion in log
    space. These are the scores of the model file, normalised
    (:func:`file_log_probabilities`), so a text's score depends on nothing
    but itself. Paths meet before every word, so a text's is the product of
    its words'; each different word of a batch is summed once. With
    ``corpus``, two more columns have the same sums under probabilities that
    are fitted on all documents (:func:`fit_unigram`), the file's scores
    weighing the segmentations: texts of the corpus' own sort take fewer
    bits there.

    Defined results: a null text has null scores; an empty one a log
    probability of 0 and null bits; characters without a piece count as their
    bytes; repeated rows get equal scores; extra columns pass through, but
    for those with the names of the ones made. An empty table gives an empty
    one.
    """
    vocab = vocabulary(model)
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    plain, fitted = file_log_probabilities(vocab), fit_unigram(docs, model, prior) if corpus else None
    made = [(log_prob, bits), (corpus_log_prob, corpus_bits)][: 1 + corpus]
    own = [n for n in docs.columns if n.lower() not in {x.lower() for pair in made for x in pair}]
    raw, length = fresh(docs, "scored", "scored_n")
    fields = [f"s{i}" for i in range(len(made))]

    @F.arrow_udf(f"struct<{', '.join(f'{f}: double' for f in fields)}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = Lattice(held.value, plain, fitted)
        for texts in batches:
            parts = []
            for a, b in slices(texts, 1 << 20, SLICE_CHARS):
                counts, coded = lattice.vocab.segments(texts.slice(a, b - a))
                owner, word = np.repeat(np.arange(len(counts)), counts), coded.indices.to_numpy()
                parts.append(np.stack([np.bincount(owner, each[word], len(counts)) for each in lattice.forward(coded.dictionary.to_pylist())]))
            value = np.concatenate(parts, 1) if parts else np.zeros((len(fields), 0))
            null = pc.is_null(texts)
            yield pa.StructArray.from_arrays([pc.if_else(null, pa.scalar(None, pa.float64()), pa.array(v, pa.float64())) for v in value], names=fields)
        give_back()

    out = docs.select(*cols(own), run(col("text").cast("string")).alias(raw), F.length(col("text").cast("string")).alias(length))
    scores = []
    for f, (name, per) in zip(fields, made):
        value = F.col(raw)[f]
        scores += [value.alias(name), F.when(F.col(length) > 0, -value / (math.log(2) * F.col(length))).alias(per)]
    return out.select(*cols(own), *scores)


def op10_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(load(spark, sf_dir, "documents"), corpus=True).select("doc_id", "log_prob", "bits_per_char", "corpus_log_prob", "corpus_bits_per_char")


QUERIES = {"op10_lattice_likelihood": op10_lattice_likelihood}
ORACLES: dict[str, str] = {}
