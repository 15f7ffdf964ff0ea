"""A vocabulary of subword pieces as a lattice over texts."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments up to this length are handled many at a time, longer ones by the stream.
LOCKSTEP = 48
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNK_PENALTY = 10.0


class Vocabulary:
    """Pieces with their scores, and a trie over their characters.

    The trie is kept as one array by row displacement: the child of node v by
    symbol c lies at ``base[v] + c`` if ``owner`` there is v.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], unigram: bool = False, dummy_prefix: bool = True):
        self.pieces, self.unigram, self.dummy_prefix = pieces, unigram, dummy_prefix
        self.score = np.array(scores, np.float64)
        self.kind = np.array(kinds)
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and pieces[i]]
        self.longest = max(len(pieces[i]) for i in usable)
        self.unk_score = float(min(self.score[i] for i in usable)) - UNK_PENALTY
        self.unk_id = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        by_byte = {pieces[i]: i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_ids = np.array([by_byte[f"<0x{b:02X}>"] for b in range(256)], np.int32) if len(by_byte) == 256 else None
        chars = sorted({c for i in usable for c in pieces[i]})
        self.symbol = np.zeros(0x110000, np.uint16)
        for i, c in enumerate(chars):
            self.symbol[ord(c)] = i + 1
        children: list[dict[int, int]] = [{}]
        piece_of = [-1]
        for i in usable:
            v = 0
            for c in pieces[i]:
                s = int(self.symbol[ord(c)])
                nxt = children[v].get(s)
                if nxt is None:
                    nxt = children[v][s] = len(children)
                    children.append({})
                    piece_of.append(-1)
                v = nxt
            if piece_of[v] < 0:
                piece_of[v] = i
        self.piece_of = np.array(piece_of, np.int32)
        width = len(chars) + 1
        size = 2 * len(children) + 2 * width
        self.base = np.zeros(len(children), np.int32)
        self.owner = np.full(size, -1, np.int32)
        self.child = np.zeros(size, np.int32)
        rng = np.random.default_rng(0)
        for v in sorted(range(len(children)), key=lambda v: -len(children[v])):
            if not children[v]:
                continue
            keys = np.fromiter(children[v], np.int64, len(children[v]))
            at = 0
            while (self.owner[at + keys] >= 0).any():
                at = int(rng.integers(0, size - width))
            self.base[v] = at
            self.owner[at + keys] = v
            self.child[at + keys] = list(children[v].values())
        #: No piece goes on over a space that follows something else, so all paths meet before it.
        self.splits = not any(SPACE in re.sub(f"^{SPACE}+", "", pieces[i]) for i in usable)
        self.shown = [p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if k == BYTE else b"" for p, k in zip(pieces, kinds)]
        self.shown[self.unk_id] = " ⁇ ".encode()
        self.shown_len = np.array([len(b) for b in self.shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.shown_bytes = np.frombuffer(b"".join(self.shown), np.uint8)

    # segments

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Number of segments of each text, and all segments as coded words, without their first space.

        A text's segments are what lies between spaces; each stands for a
        space and what follows. Paths of the lattice meet at each one's begin.
        """
        texts = pc.fill_null(texts, "")
        if self.splits:
            split = pc.split_pattern(texts, " ")
            runs = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        else:
            split, runs = pa.array([[t] for t in texts.to_pylist()], pa.list_(pa.string())), np.zeros(len(texts), bool)
        if runs.any():  # a run of spaces goes before the word behind it, but for the one that begins a segment anyhow
            lists = [re.findall(r" *[^ ]+| +$", f" {t}") for t in texts.filter(pa.array(runs)).to_pylist()]
            rows = np.where(runs, len(split) + np.cumsum(runs) - 1, np.arange(len(split)))
            split = pa.concat_arrays([split, pa.array([[x[1:] for x in xs] for xs in lists], split.type)]).take(pa.array(rows))
        counts = np.diff(split.offsets.to_numpy())
        filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        values = split.values.slice(split.offsets[0].as_py(), int(counts.sum()))
        if not filled.all():  # an empty text has no segment
            values = values.filter(pa.array(np.repeat(filled, counts)))
            counts = np.where(filled, counts, 0)
        return counts, values.dictionary_encode()

    # many short segments at a time

    def _lockstep(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of (which words, their lengths, characters by place), the space included, the longest first."""
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words)) + 1
        short = np.flatnonzero(lengths <= LOCKSTEP)
        order = short[np.argsort(-lengths[short], kind="stable")]
        for at in range(0, len(order), 1 << 15):
            pick = order[at : at + (1 << 15)]
            size = lengths[pick]
            flat = np.frombuffer((SPACE + SPACE.join([words[i].replace(" ", SPACE) for i in pick])).encode("utf-32-le"), np.uint32)
            points = np.zeros((int(size[0]), len(pick)), np.uint32)
            starts = np.cumsum(size) - size
            for i in range(len(points)):
                n = int(np.searchsorted(-size, -i, "left"))  # those longer than i
                points[i, :n] = flat[starts[:n] + i]
            yield pick, size, points

    def edges(self, size: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, length, rows, pieces) of all pieces in the words, by begin and length; piece -1 is a character without a piece of its own."""
        symbols = self.symbol[points]
        for i in range(len(points)):
            n = int(np.searchsorted(-size, -i, "left"))
            rows, node = np.arange(n), np.zeros(n, np.int32)
            single = np.zeros(n, bool)
            for k in range(min(self.longest, len(points) - i)):
                slot = self.base[node] + symbols[i + k][rows]
                ok = self.owner[slot] == node
                rows, node = rows[ok], self.child[slot[ok]]
                if not len(rows):
                    break
                piece = self.piece_of[node]
                has = piece >= 0
                if has.any():
                    r = rows[has]
                    if k == 0:
                        single[r] = True
                    yield i, k + 1, r, piece[has]
            lone = np.flatnonzero(~single)
            if len(lone):
                yield i, 1, lone, np.full(len(lone), -1, np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the best path through each word, a space before it included."""
        with_unk = np.append(self.score, self.unk_score)
        held_word, held_step, held_id = [], [], []
        for pick, size, points in self._lockstep(words):
            n = len(pick)
            best = np.full((len(points) + 1, n), -np.inf)
            best[0] = 0
            back = np.zeros((len(points) + 1, n), np.int32)
            width = np.zeros((len(points) + 1, n), np.int8)
            for i, k, rows, piece in self.edges(size, points):
                value = best[i][rows] + with_unk[piece]
                better = value > best[i + k][rows]
                r = rows[better]
                best[i + k][r] = value[better]
                back[i + k][r] = piece[better]
                width[i + k][r] = k
            at, rows, step = size.copy(), np.arange(n), 0
            while len(rows):
                piece = back[at[rows], rows]
                at[rows] -= width[at[rows], rows]
                lone = piece < 0
                if lone.any():
                    piece[lone] = -1 - points[at[rows[lone]], rows[lone]].astype(np.int32)
                held_word.append(pick[rows])
                held_step.append(np.full(len(rows), step, np.int32))
                held_id.append(piece)
                rows, step = rows[at[rows] > 0], step + 1
        for i, w in enumerate(words):
            if len(w) + 1 > LOCKSTEP:
                ids = np.array(list(self.stream(SPACE + w.replace(" ", SPACE))), np.int32)
                held_word.append(np.full(len(ids), i))
                held_step.append(np.arange(len(ids) - 1, -1, -1, dtype=np.int32))
                held_id.append(ids)
        if not held_id:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, step, ids = map(np.concatenate, (held_word, held_step, held_id))
        order = np.lexsort((-step, word))
        word, ids = word[order], ids[order]
        word, ids = self._spell(word, ids)
        return ids, np.searchsorted(word, np.arange(len(words) + 1))

    def _spell(self, word: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece, held as -1 less their code point, as the ids of their bytes."""
        lone = ids < 0
        if not lone.any():
            return word, ids
        if self.byte_ids is None:
            return word, np.where(lone, self.unk_id, ids)
        point = np.where(lone, -1 - ids.astype(np.int64), 0)
        count = np.where(lone, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        point, total, lone = (np.repeat(x, count) for x in (point, count, lone))
        low = (point >> (6 * (total - 1 - nth))) & 0x3F
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[total]
        byte = np.where(total == 1, point, np.where(nth == 0, lead | (point >> (6 * (total - 1))), 0x80 | low))
        return np.repeat(word, count), np.where(lone, self.byte_ids[np.minimum(byte, 255)], np.repeat(ids, count)).astype(np.int32)

    # one text of any length

    def stream(self, text: str | Iterable[str], every: int = 16, watch: Callable[[int], None] | None = None) -> Iterator[int]:
        """Ids of the best path over a text, or over pieces of one as they come, given out as soon as they are certain.

        Scores are kept for the places that a piece from here on can still
        begin or end at: those of a window of the ``longest`` piece. When
        the paths back from all of them share a boundary, whatever comes,
        the best path goes through it; what lies before is given out and
        forgotten. Characters are read when a piece could reach them. Where
        paths stay apart for long, as they may in periodic text, one back
        pointer a place is kept for as long. ``watch`` is told how many
        places are held. Characters without a piece come as -1 less their
        code point.
        """
        if not hasattr(self, "lists"):
            self.lists = [x.tolist() for x in (self.base, self.owner, self.child, self.piece_of, self.score)]
        base, owner, child, piece_of, score = self.lists
        longest = self.longest
        chunks = iter([text] if isinstance(text, str) else text)
        ahead: deque[tuple[int, int]] = deque()  # (code point, symbol) of what is read and not yet passed
        start, i, ended = 0, 0, False
        best: deque[float] = deque([0.0])  # by place from i on
        back: list[tuple[int, int]] = [(-1, 0)]  # (piece, length) by place from start on
        check = every
        while True:
            while len(ahead) < longest and not ended:
                more = next(chunks, None)
                ended = more is None
                if more:
                    points = np.frombuffer(more.encode("utf-32-le", "surrogatepass"), np.uint32)
                    ahead.extend(zip(points.tolist(), self.symbol[points].tolist()))
            if not ahead:
                break
            reach = min(longest, len(ahead))
            while len(best) <= reach:
                best.append(-np.inf)
                back.append((-1, 0))
            here, v, single = best[0], 0, False
            at = i - start
            for k, (_, symbol) in enumerate(islice(ahead, reach)):
                slot = base[v] + symbol
                if owner[slot] != v:
                    break
                v = child[slot]
                piece = piece_of[v]
                if piece >= 0:
                    single |= k == 0
                    value = here + score[piece]
                    if value > best[k + 1]:
                        best[k + 1], back[at + k + 1] = value, (piece, k + 1)
            if not single and here + self.unk_score > best[1]:
                best[1], back[at + 1] = here + self.unk_score, (-1 - ahead[0][0], 1)
            ahead.popleft()
            best.popleft()
            i += 1
            last = not ahead and ended
            if last or i >= check:
                # the place i is final; pieces to come begin there, and those on the way end behind
                live = {i} if last else {i + j for j, b in enumerate(best) if b > -np.inf} | {i}
                while len(live) > 1 and max(live) > start:
                    j = max(live)
                    live.remove(j)
                    live.add(j - back[j - start][1])
                meet = max(live)
                if watch:
                    watch(len(back))
                if meet > start:
                    out, j = [], meet
                    while j > start:
                        piece, k = back[j - start]
                        out.append(piece)
                        j -= k
                    yield from reversed(out)
                    back, start = back[meet - start :], meet
                    shift = best[0]
                    best = deque(b - shift for b in best)
                # where paths stay apart for long it is asked ever more seldom
                check = max(meet + every, i + (i - start))

    # whole texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts; null texts have none."""
        counts, coded = self.segments(texts)
        ids, at = self.encode_words(coded.dictionary.to_pylist())
        word = coded.indices.to_numpy()
        length = (at[1:] - at[:-1])[word]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.arange(total) + np.repeat(at[word] - (ends - length), length)] if total else ids[:0]
        per_text = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return flat, per_text

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts of ``ids``, and each text's place in it; the space put before a text is taken off."""
        length = self.shown_len[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.shown_bytes[np.arange(total) + np.repeat(self.shown_at[ids] - (ends - length), length)] if total else self.shown_bytes[:0]
        at = np.append(0, ends)[offsets]
        first = at[:-1][at[1:] > at[:-1]]
        first = first[flat[first] == 0x20]
        if self.dummy_prefix and len(first):
            at = at - np.searchsorted(first, at, "left")
            flat = np.delete(flat, first)
        return flat, at


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return Vocabulary(
        [p.piece for p in model.pieces],
        [p.score for p in model.pieces],
        [p.type for p in model.pieces],
        model.trainer_spec.model_type == 1,
        model.normalizer_spec.add_dummy_prefix,
    )
