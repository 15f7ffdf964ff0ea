"""What a viewer of the graph asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, is_entity, label

SEARCH = 15
PLAIN = "#64748b"


def ends(edges: DataFrame, tally: DataFrame | None = None) -> DataFrame:
    """(id, degree): ends of edges at the nodes that have any.

    ``tally`` (src, n) has edges that are counted by where they begin and so aren't among ``edges``.
    """
    out = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    if tally is None:
        return out
    return out.unionByName(tally.select(F.col("src").alias("id"), F.col("n").alias("degree"))).groupBy("id").agg(F.sum("degree").alias("degree"))


def degrees(nodes: DataFrame, edges: DataFrame, tally: DataFrame | None = None) -> DataFrame:
    """(id, degree): ends of edges at each node; an edge to itself has two. ``tally`` is as for :func:`ends`."""
    return nodes.select("id").join(ends(edges, tally), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, size, kind_shown, community_shown): how large a node is drawn, and what as."""
    outside, entity = F.coalesce("external", F.lit(False)), is_entity(F.col("kind"))
    grown = clamp((F.col("degree") * 3 + 5).cast("long"), 10, 25).cast("long")
    return nodes.join(degrees(nodes, edges), "id").select(
        "id",
        F.when(entity, F.lit(5)).when(outside, F.lit(8)).otherwise(grown).cast("long").alias("size"),
        F.when(entity, F.col("kind")).when(outside, "external").otherwise("file").alias("kind_shown"),
        F.coalesce(F.nullif("community", F.lit("")), F.lit("other")).alias("community_shown"),
    )


def drawn_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with title, dashes, width and the colour of where they begin."""
    inside = F.col("relation").eqNullSafe(F.lit("contains"))
    colors = nodes.select(F.col("id").alias("src"), F.col("color").alias("src_color"))
    return edges.join(colors, "src", "left").select(
        "src", "dst",
        F.when(inside, "contains").otherwise(F.coalesce("relationship", F.lit("imports"))).alias("title"),
        inside.alias("dashes"),
        F.when(inside, 1).otherwise(2).alias("width"),
        F.coalesce("src_color", F.lit(PLAIN)).alias("color"),
    )


def communities(nodes: DataFrame, order: str = "id") -> DataFrame:
    """(community, nodes, color): all nodes of each community, and its first member's colour, null where nodes have none.

    A row stands for as many nodes as its ``times`` says, if there is such a column.
    """
    color = F.min_by("color", order) if "color" in nodes.columns else F.first(F.lit(None).cast("string"))
    name = F.coalesce(F.nullif("community", F.lit("")), F.lit("other"))
    count = F.sum("times") if "times" in nodes.columns else F.count("*")
    return nodes.groupBy(name.alias("community")).agg(count.cast("long").alias("nodes"), color.alias("color"))


def legend(nodes: DataFrame, order: str = "id") -> DataFrame:
    """Communities by name, without those of externals and entities."""
    return communities(nodes, order).where(~F.col("community").isin("dependencies", "entities")).orderBy(F.lower("community"), "community")


def search(nodes: DataFrame, text: str, limit: int = SEARCH, order: str = "id") -> DataFrame:
    """(id, label): the first nodes whose label contains ``text`` in any case."""
    name = label(F.col("label"), F.col("id"))
    return nodes.select("id", name.alias("label"), *({order} - {"id"})).where(F.lower("label").contains(text.lower())).orderBy(order).limit(limit).select("id", "label")


def visible(nodes: DataFrame, hidden: list[str] | None = None, only: str | None = None, packages_only: bool = False, entities: bool = True) -> DataFrame:
    """Nodes that the filters leave: of communities, of externals that are packages, of entities."""
    name = F.coalesce(F.nullif("community", F.lit("")), F.lit("other"))
    keep = F.lit(True)
    if hidden:
        keep &= ~name.isin(hidden)
    if only is not None:
        keep &= name == only
    if packages_only:
        keep &= ~F.coalesce("external", F.lit(False)) | F.coalesce("npm", F.lit(False))
    if not entities:
        keep &= ~is_entity(F.col("kind"))
    return nodes.where(keep)


def connected(edges: DataFrame, target: str) -> DataFrame:
    """(id): what shares an edge with ``target``, whichever way."""
    touching = edges.where((F.col("src") == target) | (F.col("dst") == target))
    return touching.select(F.when(F.col("src") == target, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()


def in_cycles(nodes: DataFrame, edges: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges that lie on cycles."""
    members = cycles.select(F.explode("files.id").alias("id")).distinct()
    steps = cycles.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst")).distinct()
    return nodes.join(members, "id", "left_semi"), edges.join(steps, ["src", "dst"], "left_semi")


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: the rectangle of all nodes with a margin of 5 %, or 50 where it has no extent."""
    a = nodes.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)))
    pad = {c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), (F.col(f"max_{c}") - F.col(f"min_{c}")) * 0.05).otherwise(50.0) for c in ("x", "y")}
    return a.select(*((F.col(f"min_{c}") - pad[c]).alias(f"min_{c}") for c in "xy"), *((F.col(f"max_{c}") - F.col(f"min_{c}") + pad[c] * 2).alias(f"range_{c}") for c in "xy"))


def escape(text):
    """Text safe inside a page."""
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text
