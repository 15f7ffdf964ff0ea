"""Communities, names, colours and sizes of nodes."""

from __future__ import annotations

from collections import defaultdict
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamp, common_root, dirname, extension, is_entity, is_file, label, parent, relative_path
from ..functions.languages import language
from .components import by_component
from .storage import DRIVER_LINKS, few, numbered, stored, unsent
from .ui import ends

PALETTE = tuple(f"#{c}" for c in "4E79A7 F28E2B E15759 76B7B2 59A14F EDC948 B07AA1 FF9DA7 9C755F BAB0AC AF7AA1 86BCB6".split())
EXTERNAL_COLOR, ENTITY_COLOR, PLAIN_COLOR = "#2d6a4f", "#6a2d6a", "#94a3b8"
ENTITY_SIZE = 3.0


def undirected(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: files that are linked, whichever way and however often."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(unsent(files.select(F.col("id").alias("a"))), "a", "left_semi").join(unsent(files.select(F.col("id").alias("b"))), "b", "left_semi")


def louvain_partition(order: list[str], links: list[tuple], of: float | None = None, loops: dict[str, float] | None = None) -> dict[str, int]:
    """Communities of a graph by modularity, the same at every run.

    Links are (a, b) or (a, b, weight); ``loops`` are twice the weights that
    nodes, as groups of others, have inside; ``of`` is twice the weight of
    the whole graph, if there is more of it than this, as modularity weighs
    by all. Nodes are visited in ``order`` and move to the neighbouring
    community that gains most, ties to the one first met in that order;
    communities then become the nodes of the next level.
    """
    place = {n: i for i, n in enumerate(order)}
    weight: list[dict[int, float]] = [defaultdict(float) for _ in order]
    inside = [(loops or {}).get(n, 0.0) for n in order]
    for a, b, *w in links:
        weight[place[a]][place[b]] += w[0] if w else 1.0
        weight[place[b]][place[a]] += w[0] if w else 1.0
    own = list(range(len(order)))
    total = of or sum(map(sum, (w.values() for w in weight))) + sum(inside)
    if not links:
        return {n: i for i, n in enumerate(order)}
    while True:
        n = len(weight)
        degree = [sum(w.values()) + inside[i] for i, w in enumerate(weight)]
        part = list(range(n))
        mass = degree[:]
        moved, moved_ever = True, False
        while moved:
            moved = False
            for i in range(n):
                near: dict[int, float] = defaultdict(float)
                for j, w in weight[i].items():
                    near[part[j]] += w
                old = part[i]
                mass[old] -= degree[i]
                best, gain = old, near.get(old, 0.0) - mass[old] * degree[i] / total
                for c in sorted(near):
                    g = near[c] - mass[c] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += degree[i]
                if best != old:
                    part[i], moved, moved_ever = best, True, True
        number: dict[int, int] = {}
        for i in range(n):
            number.setdefault(part[i], len(number))
        own = [number[part[o]] for o in own]
        if not moved_ever or len(number) == n:
            return {node: own[place[node]] for node in order}
        merged: list[dict[int, float]] = [defaultdict(float) for _ in number]
        inner = [0.0] * len(number)
        for i in range(n):
            a = number[part[i]]
            inner[a] += inside[i]
            for j, w in weight[i].items():
                b = number[part[j]]
                if a == b:
                    inner[a] += w
                else:
                    merged[a][b] += w
        weight, inside = merged, inner


#: Rounds of moves at a level, and the share of nodes that must move for another.
ROUNDS, FEW_MOVES = 12, 0.002


def _moves(links: DataFrame, loops: DataFrame, total: float) -> DataFrame:
    """(node, c): a level of moves of nodes to neighbouring communities, all of one half at a time.

    A round sums each node's links by the community they lead to, where the
    links are, and takes the best; half of the nodes, by a hash that changes
    with the round, may move, so that two neighbours seldom exchange places.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    degree = stored(both.select("a", "w").unionByName(loops.select(F.col("node").alias("a"), "w")).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("deg")))
    held = degree.select("node", F.col("node").alias("c"), "deg")
    n = degree.count()
    for turn in range(ROUNDS):
        mass = held.groupBy("c").agg(F.sum("deg").alias("mass"))
        to = held.select(F.col("node").alias("b"), "c")
        near = both.join(to, "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
        mine = held.select("node", F.col("c").alias("own"), "deg")
        seen = near.join(mine, "node").join(mass, "c")
        alone = F.when(F.col("c") == F.col("own"), F.col("deg")).otherwise(0.0)
        gain = F.col("w") - (F.col("mass") - alone) * F.col("deg") / total
        told = seen.select("node", "own", "c", gain.alias("gain"))
        best = told.groupBy("node").agg(F.max(F.struct("gain", "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
        free = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        own_mass = mine.join(mass.withColumnRenamed("c", "own").withColumnRenamed("mass", "own_mass"), "own")
        step = own_mass.join(best, "node", "left")
        stay = F.coalesce("stay", -(F.col("own_mass") - F.col("deg")) * F.col("deg") / total)
        go = F.coalesce(free & (F.col("best.gain") > stay + 1e-12), F.lit(False))
        moved = stored(step.select("node", F.when(go, F.col("best.c")).otherwise(F.col("own")).alias("c"), "deg", go.alias("moved")))
        held = moved.select("node", "c", "deg")
        if turn % 2 and moved.where("moved").count() <= FEW_MOVES * n:
            break
    return held.select("node", "c")


def _partition(links: list[tuple], total: float) -> list[tuple[str, str]]:
    """(node, first node of its community) for links (a, b, place of a, place of b)."""
    place = {n: o for a, b, x, y in links for n, o in ((a, x), (b, y))}
    order = sorted(place, key=lambda n: (place[n] is not None, place[n] or 0, n))
    part = louvain_partition(order, sorted((a, b) for a, b, *_ in links), total)
    first: dict[int, str] = {}
    for n in order:
        first.setdefault(part[n], n)
    return [(n, first[part[n]]) for n in order]


def louvain(nodes: DataFrame, edges: DataFrame, enough: int = DRIVER_LINKS) -> DataFrame:
    """(id, community): the community of each file, named by its first member. A file without links is alone.

    No more than ``enough`` links are partitioned on the driver. Otherwise
    tasks partition the links of whole connected components, with the same
    result. In components of more than ``enough`` links nodes move in Spark
    and their communities become the nodes of a smaller graph, until the
    driver can partition what is left. Names of the groups on the way are
    those of members.
    """
    spark = nodes.sparkSession
    files = nodes.where(is_file(F.col("external"), F.col("kind")))
    order = F.col("ord").cast("long") if "ord" in nodes.columns else F.lit(0).cast("long")
    files = files.select("id", order.alias("ord"))
    pairs = stored(undirected(files, edges))
    size = pairs.count()
    total = 2.0 * size
    loops = spark.createDataFrame([], "node string, w double")
    own = files.select("id", F.col("id").alias("node"), "ord")
    if size > enough:
        place = lambda end: unsent(files.select(F.col("id").alias(end), F.col("ord").alias(f"{end}_ord")))
        placed = pairs.join(place("a"), "a").join(place("b"), "b").select("a", "b", "a_ord", "b_ord")
        parted, rest = by_component(placed, partial(_partition, total=total), "node string, c string", enough)
        own = stored(own.join(unsent(parted), "node", "left").select("id", F.coalesce("c", "node").alias("node"), "ord"))
        pairs = rest if rest is not None else pairs.where("false")
    links = stored(pairs.select("a", "b", F.lit(1.0).alias("w")))
    size = links.count()
    while size > enough:
        to = _moves(links, loops, total)
        groups = links.join(to.select(F.col("node").alias("a"), F.col("c").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("c").alias("y")), "b")
        groups = stored(groups.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")))
        kept = loops.join(to, "node").select(F.col("c").alias("node"), "w")
        loops = stored(kept.unionByName(groups.where("a = b").select(F.col("a").alias("node"), (F.col("w") * 2).alias("w"))).groupBy("node").agg(F.sum("w").alias("w")))
        own = stored(own.join(to, "node", "left").select("id", F.coalesce("c", "node").alias("node"), "ord"))
        links = groups.where("a <> b")
        before, size = size, links.count()
        if size > 0.98 * before:  # hardly anything moves any more
            break
    if 0 < size <= enough:
        firsts = own.groupBy("node").agg(F.min("ord").alias("first"))
        touched = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        names = [r.node for r in firsts.join(touched, "node", "left_semi").orderBy("first", "node").collect()]
        inside = {r.node: r.w for r in loops.join(touched, "node", "left_semi").collect()}  # what no link leads to can't move
        part = louvain_partition(names, [tuple(r) for r in links.orderBy("a", "b").collect()], total, inside)
        own = own.join(spark.createDataFrame([(n, f"{c}") for n, c in part.items()], "node string, c string"), "node", "left").select("id", F.coalesce(F.concat(F.lit("#"), "c"), F.concat(F.lit("="), "node")).alias("node"), "ord")
    named = own.groupBy("node").agg(F.min(F.struct("ord", "id")).alias("f"))
    return own.join(unsent(named), "node").select("id", F.col("f.id").alias("community"))


def community_names(members: DataFrame) -> DataFrame:
    """(community, name) from (community, dir, ord): the commonest folder, equal names numbered.

    Of equally common folders the first seen wins; communities count in the
    order of their first member.
    """
    counted = members.groupBy("community", "dir").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = counted.groupBy("community").agg(F.max_by("dir", F.struct("n", -F.col("first"))).alias("dir"), F.min("first").alias("first"))
    same = Window.partitionBy("dir")
    return best.select(
        "community",
        F.when(F.count("*").over(same) > 1, F.concat("dir", F.lit(" #"), F.row_number().over(same.orderBy("first", "community")).cast("string"))).otherwise(F.col("dir")).alias("name"),
    )


def community_palette(members: DataFrame) -> DataFrame:
    """(community, color_idx) from (community, ord): places 0 to 11 in order of the communities' first members."""
    first = members.groupBy("community").agg(F.min("ord").alias("first"))
    return numbered(first, "first", "community").select("community", (F.col("n") % len(PALETTE)).cast("long").alias("color_idx"))


def entity_communities(nodes: DataFrame) -> DataFrame:
    """(id, parent, community): entities with the community of the file before their last ``::``, ``other`` without one.

    Entities stay where they are formed if files are few enough to go there.
    """
    inner = nodes.where(is_entity(F.col("kind"))).select("id", parent(F.col("id")).alias("parent"))
    outer = few(stored(nodes.where(is_file(F.col("external"), F.col("kind"))).select(F.col("id").alias("parent"), "community")))
    return inner.join(outer, "parent", "left").select("id", "parent", F.coalesce("community", F.lit("other")).alias("community"))


def enrich(nodes: DataFrame, edges: DataFrame, seed: int = 7, tally: DataFrame | None = None) -> DataFrame:
    """``nodes`` with label, language, community, colour, size and a place to start drawing from.

    Entities need their file's community only, so they aren't shuffled if
    files are few. ``tally`` (src, n) has edges that are counted already and
    so aren't among ``edges``.
    """
    files = nodes.where(is_file(F.col("external"), F.col("kind")))
    root = common_root(files.select(F.col("id").alias("path")))
    ids = louvain(nodes, edges)
    folder = relative_path(dirname(F.col("id")), root or "/")
    members = ids.join(unsent(files.select("id", "ord")), "id").withColumn("dir", F.when(folder == "", ".").otherwise(folder))
    names = members.select("id", "community").join(unsent(community_names(members)), "community").join(unsent(community_palette(members)), "community")
    palette = F.array(*map(F.lit, PALETTE))
    named = stored(names.select("id", F.col("name").alias("c_name"), F.element_at(palette, (F.col("color_idx") + 1).cast("int")).alias("c_color")))
    entity, outside = is_entity(F.col("kind")), F.coalesce("external", F.lit(False))
    keep = [c for c in nodes.columns if c not in ("label", "language", "community", "color", "size", "x", "y")]
    shown = [*keep, label(F.col("label"), F.col("id")).alias("label")]
    solid = nodes.where(~entity).join(unsent(named), "id", "left").join(unsent(ends(edges, tally)), "id", "left").select(
        *shown,
        F.when(~outside, language(extension(F.col("id")))).alias("language"),
        F.when(outside, "dependencies").otherwise(F.coalesce(F.col("c_name"), F.when(folder == "", ".").otherwise(folder))).alias("community"),
        F.when(outside, EXTERNAL_COLOR).otherwise(F.coalesce("c_color", F.lit(PLAIN_COLOR))).alias("color"),
        clamp(F.coalesce("degree", F.lit(0)).cast("double"), 5.0, 15.0).alias("size"),
    )
    above = few(named.select(F.col("id").alias("parent_id"), F.col("c_name").alias("p_name")))
    inner = nodes.where(entity).join(above, parent(F.col("id")) == F.col("parent_id"), "left").select(
        *shown,
        F.lit(None).cast("string").alias("language"),
        F.when(outside, "dependencies").otherwise(F.coalesce("p_name", F.lit("other"))).alias("community"),
        F.when(outside, EXTERNAL_COLOR).otherwise(ENTITY_COLOR).alias("color"),
        F.lit(ENTITY_SIZE).alias("size"),
    )
    return solid.unionByName(inner).withColumns({"x": F.rand(seed) * 100, "y": F.rand(seed + 1) * 100})

