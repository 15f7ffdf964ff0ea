"""Lookups and paths in a graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import resolve as resolve_path
from .storage import DRIVER_LINKS, numbered, pairs_if_few, stored

CHOICES = 25


def resolve_node(nodes: DataFrame, target: str, folder: str = "/", limit: int = CHOICES, order: str = "id") -> DataFrame:
    """Nodes that ``target`` may mean: that id, else the path seen from ``folder``, else ids and labels that contain it in any case.

    No row means that nothing was found, several leave the choice to the
    reader; of the last kind at most ``limit`` come, in order.
    """
    where = resolve_path(F.lit(folder), F.lit(target))
    text = F.lit(target.lower())
    tier = (
        F.when(F.col("id") == target, 0)
        .when(F.col("id") == where, 1)
        .when(F.lower("id").contains(text) | F.coalesce(F.lower("label").contains(text), F.lit(False)), 2)
    )
    found = nodes.withColumn("tier", tier).where("tier is not null")
    best = found.agg(F.min("tier").alias("best"))
    return found.crossJoin(F.broadcast(best)).where("tier = best").orderBy(order).limit(limit).drop("tier", "best")


def dependencies_of(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Distinct nodes that ``target`` leads to."""
    return nodes.join(edges.where(F.col("src") == target).select(F.col("dst").alias("id")).distinct(), "id", "left_semi")


def dependents_of(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Distinct nodes that lead to ``target``."""
    return nodes.join(edges.where(F.col("dst") == target).select(F.col("src").alias("id")).distinct(), "id", "left_semi")


def roots(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files that no file leads to."""
    return files.select("id").join(links.select(F.col("dst").alias("id")), "id", "left_anti")


def distances(links: DataFrame, starts: DataFrame, enough: int = DRIVER_LINKS) -> DataFrame:
    """(root, id, depth): the distance of everything that each of ``starts`` (id) reaches.

    If links times starts are no more than ten times ``enough``, the driver
    follows them. Otherwise a level is one join of the frontier with the links and one anti join
    with what was reached; it is written out, so that plans stay short and
    an executor's loss costs a level at most.
    """
    links = stored(links.select("src", "dst").distinct())
    reached = frontier = stored(starts.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
    n = reached.count()
    if n <= enough and (few := pairs_if_few(links, min(enough, 10 * enough // max(1, n)))) is not None:
        names = [r.id for r in reached.select("id").distinct().collect()]
        rows = [(names[i], node, depth) for depth, level in enumerate(_levels(few, names)) for node, bits in level.items() for i in _bits(bits)]
        return links.sparkSession.createDataFrame(rows, reached.schema)
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        ahead = frontier.join(links, frontier.id == links.src).select("root", F.col("dst").alias("id")).distinct()
        frontier = stored(ahead.join(reached, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(frontier)
    return reached


def _bits(value: int) -> Iterator[int]:
    while value:
        low = value & -value
        yield low.bit_length() - 1
        value ^= low


def _levels(few: list[tuple], starts: list) -> Iterator[dict]:
    """Level by level, the nodes newly reached by any start, each with the starts' bits."""
    out: dict = {}
    for a, b in few:
        out.setdefault(a, []).append(b)
    seen: dict = {}
    for i, s in enumerate(starts):
        seen[s] = seen.get(s, 0) | 1 << i
    frontier = dict(seen)
    while frontier:
        yield frontier
        ahead: dict = {}
        for node, bits in frontier.items():
            for to in out.get(node, ()):
                ahead[to] = ahead.get(to, 0) | bits
        frontier = {n: new for n, bits in ahead.items() if (new := bits & ~seen.get(n, 0))}
        for n, bits in frontier.items():
            seen[n] = seen.get(n, 0) | bits


def eccentricity(links: DataFrame, starts: DataFrame, enough: int = DRIVER_LINKS) -> int:
    """The largest distance of anything from one of ``starts`` (id) that reaches it; 0 if they reach nothing.

    No more than ``enough`` links are followed on the driver. Otherwise
    starts go in groups of 64: a row holds a node, a group and the bits of
    those that have reached it. A level is one join of the frontier with the
    links and one with what was reached, which is written anew.
    """
    links = stored(links.select("src", "dst").distinct())
    if (few := pairs_if_few(links, enough)) is not None:
        going = {a for a, _ in few}
        known = starts.join(links.select(F.col("src").alias("id")), "id", "left_semi")
        return max(0, sum(1 for _ in _levels(few, [r.id for r in known.select("id").distinct().collect() if r.id in going])) - 1)
    n = numbered(starts.select("id").join(links.select(F.col("src").alias("id")), "id", "left_semi"), "id")
    seen = stored(n.select((F.col("n") / 64).cast("long").alias("grp"), "id", F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("n") % 64).cast("int")).alias("bits")).withColumn("new", F.col("bits")))
    depth = 0
    while True:
        frontier = seen.where("new <> 0").select("grp", F.col("id").alias("src"), "new")
        ahead = frontier.join(links, "src").groupBy("grp", F.col("dst").alias("id")).agg(F.bit_or("new").alias("come"))
        bits, come = F.coalesce("bits", F.lit(0)), F.coalesce("come", F.lit(0))
        seen = stored(seen.drop("new").join(ahead, ["grp", "id"], "full").select("grp", "id", bits.bitwiseOR(come).alias("bits"), come.bitwiseAND(F.bitwise_not(bits)).alias("new")))
        if seen.where("new <> 0").isEmpty():
            return depth
        depth += 1


def shortest_path(edges: DataFrame, source: str, target: str, order: DataFrame | None = None, enough: int = DRIVER_LINKS) -> list[str] | None:
    """The nodes of a shortest directed path, None if there is none.

    Whole levels grow from both ends, the smaller frontier first, until they
    meet. Of equal paths the one through the least ids is given, seen from
    where the ends meet. No more than ``enough`` links are followed on the
    driver.
    """
    if source == target:
        known = edges.where((F.col("src") == source) | (F.col("dst") == source)).limit(1)
        return [source] if not known.isEmpty() or order is None or not order.where(F.col("id") == source).isEmpty() else None
    links = stored(edges.select("src", "dst").distinct())
    if (few := pairs_if_few(links, enough)) is not None:
        return _meeting(few, source, target)
    spark = edges.sparkSession
    begin = lambda node: stored(spark.createDataFrame([(node, None)], "id string, via string"))
    seen = {"src": [begin(source)], "dst": [begin(target)]}
    size = {"src": 1, "dst": 1}
    while True:
        side, other = ("src", "dst") if size["src"] <= size["dst"] else ("dst", "src")
        frontier = seen[side][-1].select(F.col("id").alias("at"))
        ahead = links.join(frontier, links[side] == F.col("at")).groupBy(F.col(other).alias("id")).agg(F.min("at").alias("via"))
        known = seen[side][0]
        for level in seen[side][1:]:
            known = known.unionByName(level)
        level = stored(ahead.join(known.select("id"), "id", "left_anti"))
        size[side] = level.count()
        if not size[side]:
            return None
        seen[side].append(level)
        theirs = seen[other][0]
        for more in seen[other][1:]:
            theirs = theirs.unionByName(more)
        meet = level.join(theirs.select("id"), "id", "left_semi").agg(F.min("id").alias("id")).first().id
        if meet is not None:
            return [*reversed(_walk(seen["src"], meet)), meet, *_walk(seen["dst"], meet)]


def _meeting(few: list[tuple], source: str, target: str) -> list[str] | None:
    out: dict[str, dict[str, list[str]]] = {"src": {}, "dst": {}}
    for a, b in few:
        out["src"].setdefault(a, []).append(b)
        out["dst"].setdefault(b, []).append(a)
    via: dict[str, dict[str, str | None]] = {"src": {source: None}, "dst": {target: None}}
    level = {"src": [source], "dst": [target]}
    while True:
        side, other = ("src", "dst") if len(level["src"]) <= len(level["dst"]) else ("dst", "src")
        ahead: dict[str, str] = {}
        for node in level[side]:
            for to in out[side].get(node, ()):
                if to not in via[side]:
                    ahead[to] = min(ahead.get(to, node), node)
        if not ahead:
            return None
        via[side] |= ahead
        level[side] = list(ahead)
        if met := [n for n in ahead if n in via[other]]:
            ways = []
            for one in ("src", "dst"):
                node, way = via[one][min(met)], []
                while node is not None:
                    way.append(node)
                    node = via[one][node]
                ways.append(way)
            return [*reversed(ways[0]), min(met), *ways[1]]


def _walk(levels: list[DataFrame], node: str) -> list[str]:
    """From ``node`` back to where the levels began, without ``node``."""
    out: list[str] = []
    for level in reversed(levels):
        row = level.where(F.col("id") == node).first()
        if row is None:
            continue
        if row.via is None:
            break
        node = row.via
        out.append(node)
    return out


def path_lengths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, hops) for pairs (src, dst): edges on a shortest path, null if there is none."""
    reach = distances(edges, pairs.select(F.col("src").alias("id")).distinct())
    return pairs.join(reach.select(F.col("root").alias("src"), F.col("id").alias("dst"), F.col("depth").cast("long").alias("hops")), ["src", "dst"], "left")
