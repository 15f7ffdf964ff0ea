"""Circular dependencies among files."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_file, label
from ..schema import CYCLES
from .components import by_component
from .storage import DRIVER_LINKS, pairs_if_few, stored, unsent

LIMIT = 200
ARROW = " → "


def _links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, ord): links between files once each, by their first edge."""
    files = nodes.where(is_file(F.col("external"), F.col("kind"))).select("id")
    order = F.col("ord") if "ord" in edges.columns else F.lit(0)
    pairs = edges.select("src", "dst", order.cast("long").alias("ord")).groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    return pairs.join(unsent(files.select(F.col("id").alias("src"))), "src", "left_semi").join(unsent(files.select(F.col("id").alias("dst"))), "dst", "left_semi")


def without_sinks(links: DataFrame, column: str = "dst", other: str = "src", enough: int = DRIVER_LINKS) -> DataFrame:
    """Links left when nodes that lead nowhere are dropped again and again, until ``enough`` are left or all that can reach a cycle.

    With the columns exchanged, nodes that nothing leads to are dropped
    instead.
    """
    links = stored(links)
    before = links.count()
    while before > enough:
        going = links.select(F.col(other).alias(column)).distinct()
        links = stored(links.join(going, column, "left_semi"))
        now = links.count()
        if now == before:
            break
        before = now
    return links


def depth_first(starts: list[str], out: dict[str, list[str]], limit: int = LIMIT) -> list[list[str]]:
    """A closed cycle for each new back edge of one depth-first walk, without rotations of earlier ones.

    Nodes are begun with in the order of ``starts`` and left by their links'
    order; the stack is explicit, so depth isn't bounded.
    """
    return [cycle for _, cycle in _begun(starts, out, limit)]


def _begun(starts: list[str], out: dict[str, list[str]], limit: int) -> list[tuple[str, list[str]]]:
    """The cycles of :func:`depth_first`, each with the start that led to it."""
    visited: set[str] = set()
    found: dict[str, tuple[str, list[str]]] = {}
    for start in starts:
        if start in visited or len(found) >= limit:
            continue
        path, place = [start], {start: 0}
        visited.add(start)
        todo = [iter(out.get(start, ()))]
        while todo:
            for node in todo[-1]:
                if len(found) >= limit:
                    continue
                if node in place:
                    cycle = path[place[node] :]
                    least = cycle.index(min(cycle))
                    found.setdefault("|".join(cycle[least:] + cycle[:least]), (start, [*cycle, node]))
                elif node not in visited:
                    visited.add(node)
                    place[node] = len(path)
                    path.append(node)
                    todo.append(iter(out.get(node, ())))
                    break
            else:
                todo.pop()
                del place[path.pop()]
    return list(found.values())


def _walked(links: list[tuple], limit: int) -> list[tuple]:
    """(place of the start, start, number, cycle) of the cycles in links (src, dst, ord, place of src, place of dst)."""
    place = {n: o for a, b, _, x, y in links for n, o in ((a, x), (b, y))}
    out: dict[str, list[str]] = {}
    for a, b, *_ in sorted(links, key=lambda r: (r[0], r[2] is not None, r[2] or 0, r[1])):
        out.setdefault(a, []).append(b)
    starts = sorted(place, key=lambda n: (place[n] is not None, place[n] or 0, n))
    return [(place[start], start, i, cycle) for i, (start, cycle) in enumerate(_begun(starts, out, limit))]


def detect_cycles(nodes: DataFrame, edges: DataFrame, limit: int = LIMIT, enough: int = DRIVER_LINKS) -> DataFrame:
    """(id, size, files, edges, label): cycles that a depth-first walk in node order closes.

    The order of the walk decides which cycles are found. No more than
    ``enough`` links are walked on the driver. Otherwise tasks walk whole
    connected components, each up to ``limit`` cycles, as one can't tell on
    another; those of the first starts are the ones that a walk of all finds,
    so no more than ``limit`` cycles come to the driver. A component's links
    must fit in a task.
    """
    spark = nodes.sparkSession
    order = F.col("ord") if "ord" in nodes.columns else F.lit(0)
    place = lambda end: unsent(nodes.select(F.col("id").alias(end), order.cast("long").alias(f"{end}_place")))
    links = stored(_links(nodes, edges).join(place("src"), "src").join(place("dst"), "dst").select("src", "dst", "ord", "src_place", "dst_place"))
    if links.count() <= enough:
        told = _walked([tuple(r) for r in links.toLocalIterator()], limit)
    else:
        begun, _ = by_component(links, partial(_walked, limit=limit), "place long, start string, n int, cycle array<string>", enough, split=False)
        told = begun.orderBy("place", "start", "n").limit(limit).collect()
    found = [list(cycle) for *_, cycle in told]
    ends = spark.createDataFrame([(n,) for n in {n for cycle in found for n in cycle}], "id string")
    names = {r.id: r.label for r in nodes.join(ends, "id", "left_semi").select("id", label(F.col("label"), F.col("id")).alias("label")).collect()}
    rows = []
    for i, cycle in enumerate(found):
        labels = [names[n] for n in cycle]
        rows.append((i + 1, len(cycle) - 1, list(zip(cycle, labels)), list(zip(cycle, cycle[1:])), ARROW.join(labels)))
    return spark.createDataFrame(rows, CYCLES)


def strong_parts(out: dict[str, list[str]]) -> list[list[str]]:
    """The nodes that lead to themselves, by strong component, from one walk."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    waiting: list[str] = []
    there: set[str] = set()
    found = []
    for start in out:
        if start in index:
            continue
        todo = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        waiting.append(start)
        there.add(start)
        while todo:
            node, ahead = todo[-1]
            for to in ahead:
                if to not in index:
                    index[to] = low[to] = len(index)
                    waiting.append(to)
                    there.add(to)
                    todo.append((to, iter(out.get(to, ()))))
                    break
                if to in there:
                    low[node] = min(low[node], index[to])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(waiting.pop())
                        there.discard(part[-1])
                    if len(part) > 1 or node in out.get(node, ()):
                        found.append(part)
    return found


def _strong(links: list[tuple]) -> list[tuple[str, str]]:
    out: dict[str, list[str]] = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    return [(n, max(part)) for part in strong_parts(out) for n in part]


def cyclic_nodes(nodes: DataFrame, edges: DataFrame, enough: int = DRIVER_LINKS) -> DataFrame:
    """(id) of files that lead to themselves, in whatever order they are walked.

    They are the members of strong components, which
    :func:`strong_components` finds, and the files that import themselves.
    """
    links = stored(_links(nodes, edges).select("src", "dst"))
    loops = links.where("src = dst").select(F.col("src").alias("id"))
    return strong_components(links, enough).select("id").unionByName(loops).distinct()


def strong_components(links: DataFrame, enough: int = DRIVER_LINKS) -> DataFrame:
    """(id, component): nodes of the strong components of two nodes and more, named by their greatest id.

    No more than ``enough`` links are walked on the driver. Otherwise tasks
    walk the links of whole connected components. In a component of more than
    ``enough`` links every node takes the greatest id that leads to it, over
    and over; those that then lead back to the node of that id, within its
    colour, are its strong component. Those found and links between colours
    go, as no cycle uses them, and the rest is done again. A round moves a row
    for each link at most, and there are as many as the longest way within a
    colour.
    """
    links = stored(links.where("src <> dst").select("src", "dst").distinct())
    if (few := pairs_if_few(links, enough)) is not None:
        return links.sparkSession.createDataFrame(_strong(few), "id string, component string")
    found, links = by_component(links, _strong, "id string, component string", enough)
    while links is not None:
        links = without_sinks(without_sinks(links, enough=0), "src", "dst", 0)
        if links.isEmpty():
            break
        color = stored(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("color", F.col("id")))
        while True:
            ahead = links.join(color.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("more"))
            grown = F.greatest("color", F.coalesce("more", "color"))
            step = stored(color.join(ahead, "id", "left").select("id", grown.alias("color"), (grown != F.col("color")).alias("moved")))
            color = step.select("id", "color")
            if step.where("moved").isEmpty():
                break
        within = stored(
            links.join(color.select(F.col("id").alias("src"), "color"), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("other")), "dst").where("color = other").select("src", "dst", "color")
        )
        frontier = stored(color.where("id = color").select("id"))
        member = frontier
        while not frontier.isEmpty():
            back = within.join(frontier.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct()
            frontier = stored(back.join(member, "id", "left_anti"))
            member = stored(member.unionByName(frontier))
        here = color.join(member, "id", "left_semi")
        many = here.groupBy("color").count().where("count > 1").select("color")
        here = here.join(many, "color", "left_semi").select("id", F.col("color").alias("component"))
        found = found.unionByName(here)
        gone = member.select(F.col("id").alias("src"))
        links = stored(within.select("src", "dst").join(gone, "src", "left_anti").join(member.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return found


def cycle_ids(cycles: DataFrame, target: str) -> list[int]:
    """Ids of the cycles that ``target`` is in."""
    return [r.id for r in cycles.where(F.exists("files", lambda f: f["id"] == target)).select("id").orderBy("id").collect()]
