"""SentencePiece encoding and decoding by streaming Viterbi over the piece lattice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cols, fresh, give_back, load
from .language_id import slices
from .subword import MODEL, vocabulary

SLICE_CHARS = 1 << 20


def _same(texts: pa.Array, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text is the bytes decoded for it."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts, texts.slice(0, 0)])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    same = np.diff(offsets) == np.diff(at)
    if same.all():
        differ = np.flatnonzero(data[offsets[0] : offsets[-1]] != flat[at[0] : at[-1]])
        same[np.searchsorted(at - at[0], differ, "right") - 1] = False
        return same
    for i in np.flatnonzero(same):
        same[i] = bool((data[offsets[i] : offsets[i + 1]] == flat[at[i] : at[i + 1]]).all())
    return same


def encode(docs: DataFrame, model: str = MODEL, ids: str = "ids", n_ids: str = "n_ids", lossless: str = "lossless") -> DataFrame:
    """``docs`` with the piece ids of ``text``, their number, and whether they decode to the text again.

    The ids are those of the segmentation whose scores, as the model file
    has them, have the largest sum; of equal sums the one whose last piece
    begins first. Characters without a piece are spelled in byte pieces.
    Paths of the lattice meet before every word, so ids are committed word by
    word, the different words of a batch in lockstep; a word of more than 48
    characters goes through a stream that keeps a window of the longest
    piece and commits where all surviving paths share a boundary. Only the
    vocabulary, of a fixed size, is broadcast.

    Defined results: a null text has null ids; an empty one has none and is
    lossless; a text with the symbol that stands for a space in pieces
    decodes to a space there and isn't lossless; repeated rows get equal ids;
    extra columns pass through, but for those with the names of the three
    made. An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    own = [n for n in docs.columns if n.lower() not in (ids.lower(), n_ids.lower(), lossless.lower())]
    coded = fresh(docs, "coded")[0]

    @F.arrow_udf("struct<ids: array<int>, lossless: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = held.value
        for texts in batches:
            parts, same = [], []
            for a, b in slices(texts, 1 << 20, SLICE_CHARS):
                few = texts.slice(a, b - a)
                flat, at = vocab.encode(few)
                same.append(_same(few, *vocab.decode_bytes(flat, at)))
                parts.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32())))
            lists = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
            lists = pc.if_else(pc.is_null(texts), pa.scalar(None, lists.type), lists)
            yield pa.StructArray.from_arrays([lists, pa.array(np.concatenate(same) if same else [], pa.bool_())], names=["ids", "lossless"])
        give_back()

    out = docs.select(*cols(own), run(col("text").cast("string")).alias(coded))
    found = F.col(coded)["ids"]
    return out.select(*cols(own), found.alias(ids), F.size(found).cast("long").alias(n_ids), F.when(found.isNotNull(), F.col(coded)["lossless"]).alias(lossless))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids``.

    The space that encoding puts before a text is taken off; byte pieces are
    joined to characters, invalid ones becoming U+FFFD; ids out of range or
    null and control pieces show nothing, the unknown piece " ⁇ ". A null
    list has a null text and an empty one an empty text. A column named
    ``text`` is replaced; others pass through.
    """
    held = rows.sparkSession.sparkContext.broadcast(vocabulary(model))
    own = [n for n in rows.columns if n.lower() != text.lower()]

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = held.value
        top = len(vocab.pieces)
        blank = int(np.flatnonzero(vocab.shown_len == 0)[0])
        for lists in batches:
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False)
            flat = np.where((flat >= 0) & (flat < top), flat, blank)
            shown, at = vocab.decode_bytes(flat, np.append(0, np.cumsum(counts)).astype(np.int64))
            whole = shown.tobytes()
            null = pc.is_null(lists).to_pylist()
            yield pa.array([None if no else whole[a:b].decode("utf-8", "replace") for a, b, no in zip(at, at[1:], null)], pa.string())

    return rows.select(*cols(own), run(col(ids)).alias(text))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents")).select("doc_id", "ids", "n_ids", "lossless")


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
