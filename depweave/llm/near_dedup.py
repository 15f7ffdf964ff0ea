"""Near-duplicate removal: SimHash signatures searched through BK-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import col, cols, file_flags, fresh, give_back, load, stored, with_file

#: Signature bits, and the distance up to which two documents are near.
BITS, RADIUS = 128, 22
#: A pair at distance DESIGN, the farthest that counts, shares at least one shard with probability RECALL.
DESIGN, RECALL = RADIUS, 0.95
#: Signatures that a shard holds, a power of two: more make fewer tables to send and more to compare.
SHARD = 32
#: Bytes of signatures that a task searches, and signatures that one shards before it sends them on.
PART_BYTES, BLOCK = 48 << 20, 1 << 17
SEED = 977
LONG_WORD, SHINGLE, WEIGHTY = 24, 5, 16
#: Letters of scripts that put no spaces between words.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
#: The weight of the set of all words in a long text, and what a text of one word adds to it.
WHOLE, FEW = 24, 120
SLICE_CHARS = 2 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each feature of each text: the text's number and the feature's, and the features."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}_]+")
    coded = split.values.dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    word = coded.indices.to_numpy().astype(np.int64)
    names = coded.dictionary
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    names = names.to_pylist()
    long = (lengths > LONG_WORD) | pc.match_substring_regex(coded.dictionary, UNSPACED).to_numpy(zero_copy_only=False) & (lengths > SHINGLE)
    if long.any():
        known = {w: i for i, w in enumerate(names)}
        parts: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(long):
            w = names[i]
            grams = {w[j : j + SHINGLE] for j in range(len(w) - SHINGLE + 1)}
            parts[int(i)] = np.array([known.setdefault(g, len(known)) for g in sorted(grams)], np.int64)
        names = list(known)
        is_long = long[word]
        more = [parts[int(w)] for w in word[is_long]]
        owner = np.concatenate([owner[~is_long], np.repeat(owner[is_long], [len(m) for m in more])])
        word = np.concatenate([word[~is_long], *more])
    return owner, word, names


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) words of 64 signature bits for each text, and whether it has any feature.

    A feature is a word of the lower-cased text, counted once. A run of
    letters of a script without spaces, and one of more than LONG_WORD
    letters and digits in any, counts as its SHINGLE-character pieces. It weighs the
    square root of its length (of WEIGHTY characters at most), times 10, which
    takes the place of a stop list. The set of all words is one more feature,
    of weight WHOLE and FEW over their number, which is next to nothing in a
    text of some length and keeps apart texts of a few words that share the
    longest.
    """
    n = len(texts)
    owner, word, names = _words(texts)
    lengths = np.fromiter((len(w) for w in names), np.int64, len(names))
    filled = lengths[word] > 0
    pair = np.sort(owner[filled] * np.int64(max(1, len(names))) + word[filled])
    pair = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
    owner, word = pair // max(1, len(names)), pair % max(1, len(names))
    out, has = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
    if not len(pair):
        return out, has
    weight = (10 * np.sqrt(np.clip(lengths, 0, WEIGHTY))).astype(np.int32)
    first = pd.util.hash_array(np.array(names, object), categorize=False).astype(np.uint64)
    hashes = (_scramble(first), _scramble(first + _GOLD))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    who = owner[starts]
    has[who] = True
    use = weight[word]
    whole = _scramble(np.add.reduceat(hashes[0][word], starts))
    sets = (whole, _scramble(whole + _GOLD))
    share = WHOLE + FEW // np.diff(np.append(starts, len(owner)))
    for side in range(2):
        for bit in range(64):
            plane = (((hashes[side] >> np.uint64(bit)) & np.uint64(1)).astype(np.int32) << 1) - 1
            total = np.add.reduceat(plane[word] * use, starts)
            total += share.astype(np.int32) * ((((sets[side] >> np.uint64(bit)) & np.uint64(1)).astype(np.int32) << 1) - 1)
            out[who, side] |= (total > 0).astype(np.uint64) << np.uint64(bit)
    return out, has


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        held = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(held // SLICE_CHARS)) + 1), len(texts)]
        sigs = [signatures(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]
        if sigs:
            whole = np.concatenate([s for s, _ in sigs])
            has = np.concatenate([h for _, h in sigs])
            packed = pa.Array.from_buffers(pa.binary(16), len(whole), [None, pa.py_buffer(np.ascontiguousarray(whole).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.if_else(pa.array(has), packed, pa.scalar(None, pa.binary()))], names=[*batch.schema.names[:-1], "sig"])
    give_back()


def shard_plan(n: int, bits: int = BITS, design: int = DESIGN, recall: float = RECALL) -> tuple[int, int]:
    """(sampled bits, tables) for ``n`` signatures.

    A shard holds some SHARD signatures at any ``n``; the number of tables
    keeps the recall at the design distance. Bits are sampled without
    replacement, so a pair meets in a table with the chance that none of the
    ``k`` places is among the ``design`` that differ.
    """
    k = min(48, max(8, math.ceil(math.log2(max(2, n) / SHARD))), max(0, bits - design))
    meet = math.comb(max(0, bits - design), k) / math.comb(bits, k)
    return k, 1 if meet >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def _places(k: int, tables: int) -> list[np.ndarray]:
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(BITS, k, replace=False)) for _ in range(tables)]


def _keys(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    key = np.zeros(len(words), np.int64)
    for p in place:
        key = (key << 1) | ((words[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)).astype(np.int64)
    return key


def _shards(k: int, tables: int, parts: int):
    """Signatures to (part, counts, sigs): those that a part searches, table by table."""
    places = _places(k, tables)

    def send(words: np.ndarray) -> Iterator[pa.RecordBatch]:
        sent: list[tuple[list, list]] = [([], []) for _ in range(parts)]
        for t, place in enumerate(places):
            part = (_scramble(_keys(words, place).astype(np.uint64) + np.uint64(t + 1) * _GOLD) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(ends)):
                sent[p][0].append((t, ends[p + 1] - ends[p]))
                sent[p][1].append(words[order[ends[p] : ends[p + 1]]])
        for p, (counts, sigs) in enumerate(sent):
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.array(counts, np.int32).tobytes()], pa.binary()), pa.array([np.concatenate(sigs).tobytes()], pa.binary())], names=["part", "counts", "sigs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2))
            n += len(held[-1])
            if n >= BLOCK:
                yield from send(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from send(np.concatenate(held))
        give_back()

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def bk_forest(shard: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree for each shard, all grown at once.

    ``shard`` is sorted; a shard's first signature is its root. The rest go
    to the root's child at their distance from it, of which again the first
    is a node, and so on. Returns each node's root, its first and past-last
    place in the list of children, and that list as (child, edge) columns.
    """
    n = len(shard)
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    starts = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1 if n else 0))
    root = np.repeat(starts, np.diff(np.append(starts, n)))
    rest, tree = np.arange(n), root.copy()
    rest = rest[rest != root]
    tree = root[rest]
    while len(rest):
        d = _distance(sig[rest], sig[tree])
        order = np.lexsort((rest, d, tree))
        rest, tree, d = rest[order], tree[order], d[order]
        new = np.flatnonzero((np.diff(tree, prepend=-1) != 0) | (np.diff(d, prepend=-1) != 0))
        heads = rest[new]
        parent[heads], edge[heads] = tree[new], d[new]
        below = np.repeat(heads, np.diff(np.append(new, len(rest))))
        stay = rest != below
        rest, tree = rest[stay], below[stay]
    children = np.flatnonzero(parent >= 0)
    children = children[np.argsort(parent[children], kind="stable")]
    first = np.searchsorted(parent[children], np.arange(n), "left")
    last = np.searchsorted(parent[children], np.arange(n), "right")
    return root, np.stack([first, last], 1), children, edge


def bk_search(shard: np.ndarray, sig: np.ndarray, radius: int, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a shard within ``radius``: every row is a query of its shard's tree.

    From a node at distance d only the children on edges from d - radius to
    d + radius are visited, which by the triangle inequality hold all
    signatures near the query.
    """
    root, span, children, edge = bk_forest(shard, sig)
    for at in range(0, len(shard), at_once):
        query = np.arange(at, min(len(shard), at + at_once))
        node = root[query]
        while len(query):
            more_q, more_n = [], []
            for lo in range(0, len(query), 1 << 20):
                q, v = query[lo : lo + (1 << 20)], node[lo : lo + (1 << 20)]
                d = _distance(sig[q], sig[v])
                near = (d <= radius) & (v < q)
                if near.any():
                    yield q[near], v[near]
                a, b = span[v, 0], span[v, 1]
                width = b - a
                if width.any():
                    qq, dd = np.repeat(q, width), np.repeat(d, width)
                    step = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
                    child = children[np.repeat(a, width) + step]
                    go = np.abs(edge[child] - dd) <= radius
                    more_q.append(qq[go])
                    more_n.append(child[go])
            query = np.concatenate(more_q) if more_q else np.zeros(0, np.int64)
            node = np.concatenate(more_n) if more_n else np.zeros(0, np.int64)


def _linked(shard: np.ndarray, sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each signature that near ones join to an earlier one of its shard, and the first of those it is joined to."""
    label = np.arange(len(shard))
    for a, b in bk_search(shard, sig, radius):
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            least = np.minimum(la, lb)
            np.minimum.at(label, la, least)
            np.minimum.at(label, lb, least)
            while (label[label] != label).any():
                label = label[label]
    joined = np.flatnonzero(label != np.arange(len(label)))
    return sig[joined], sig[label[joined]]


def _link(radius: int, k: int, tables: int):
    """Over what :func:`_shards` sends a part: edges (a, b) between signatures, each once a part."""
    places = _places(k, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for counts, sigs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, at = np.frombuffer(sigs, np.uint64).reshape(-1, 2), 0
                for t, n in np.frombuffer(counts, np.int32).reshape(-1, 2):
                    held.setdefault(int(t), []).append(words[at : at + n])
                    at += n
        found = []
        for t, lists in held.items():
            sig = np.concatenate(lists)
            key = _keys(sig, places[t])
            order = np.argsort(key, kind="stable")
            key, sig = key[order], sig[order]
            sizes = np.diff(np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key)))
            several = np.repeat(sizes > 1, sizes)
            a, b = _linked(key[several], sig[several], radius)
            if len(a):
                found.append(np.concatenate([a, b], axis=1))
        if found:
            edges = np.unique(np.concatenate(found), axis=0)
            pick = lambda x: pa.Array.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
            for at in range(0, len(edges), 1 << 16):
                some = edges[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pick(some[:, :2]), pick(some[:, 2:])], names=["a", "b"])
        give_back()

    return run


def near_pairs(sigs: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """Edges (a, b) that join the distinct signatures ``sig`` within ``radius``.

    Shards are made by sampling signature bits, several times over. A
    shard's BK-tree stands where the shard is, which is also where all its
    queries are, so no tree has to be sent anywhere. Signatures travel in
    arrays, one for each part and block of them.
    """
    n = n if n is not None else sigs.count()
    k, tables = shard_plan(n, design=radius)
    parts = max(int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * tables * 16 / PART_BYTES))
    sent = sigs.select("sig").mapInArrow(_shards(k, tables, parts), "part int, counts binary, sigs binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(_link(radius, k, tables), "a binary, b binary").distinct()


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group that near copies join.

    Documents are near if their 128-bit SimHash signatures differ in at most
    ``radius`` bits; groups are what such pairs connect. The smallest
    ``doc_id`` stays. Pairs are searched in BK-trees over shards by sampled
    bits; by ``shard_plan`` a pair at distance ``radius`` is found with
    probability 0.95 at least, a nearer one with more.

    Defined results: null texts and texts without a letter or digit say
    nothing and stay; equal texts are near; of a group without any
    ``doc_id``, and of repeated rows, one stays; texts count in full; columns
    other than ``text`` and ``doc_id`` don't matter and pass through,
    whatever their names. An empty table gives an empty one.
    """
    names = docs.columns
    part, mark, drop, again, keep = fresh(docs, "near_part", "near_mark", "near_drop", "near_again", "near_keep")
    homed = with_file(docs, part)
    row = F.xxhash64(F.coalesce(col("doc_id").cast("string"), F.lit("none")), F.xxhash64(col("text")))
    plain = homed.select(F.col(part).alias("part"), row.alias("mark"), col("doc_id").alias("doc_id"), col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    signed = stored(plain.where("text is not null").mapInArrow(_sign, f"part long, mark long, doc_id {kind}, sig binary").where("sig is not null"))
    distinct = stored(signed.select("sig").distinct())
    groups = stored(components(near_pairs(distinct, radius), enough=0))
    whole = signed.join(groups, signed.sig == groups.node, "left").select("part", "mark", "doc_id", F.coalesce("least", "sig").alias("grp"))
    # the least of a group is a sum of parts, and joins may split a group, so its size doesn't matter
    whole = stored(whole)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    keepers = whole.groupBy("grp").agg(F.min_by("mark", order).alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
    losers = stored(whole.join(keepers, "grp").select("part", "mark", F.when(F.col("mark") == F.col("first"), 1).otherwise(0).alias("same")))
    dropped = file_flags(losers.where("same = 0"))
    repeated = stored(losers.where("same = 1").groupBy("mark").count().where("count > 1").select("mark"))
    out = homed.withColumn(mark, row).withColumn(drop, dropped(F.col(part), F.col(mark))).where(~F.col(drop))
    if repeated.isEmpty():
        return out.select(*cols(names))
    sames = file_flags(signed.join(repeated, "mark", "left_semi").select("part", "mark"))
    out = out.withColumn(again, sames(F.col(part), F.col(mark)))
    rest = [n for n in names if n not in ("text", "doc_id")]
    once = out.where(F.col(again)).groupBy(mark).agg(F.min_by(F.struct(*cols(names)), F.to_json(F.struct(*cols(rest))) if rest else F.lit("")).alias(keep))
    return out.where(~F.col(again)).select(*cols(names)).unionByName(once.select(*(F.col(keep).getField(n).alias(n) for n in names)))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLES: dict[str, str] = {}
