"""From parsed files to nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import dirname, entity_id, is_relative, resolve

#: Of entities of one name in a file the first sort in this order stays.
KINDS = (("classes", "class"), ("functions", "function"), ("methods", "method"), ("flat", "entity"))


def entities(parsed: DataFrame) -> DataFrame:
    """(file, file_ord, id, label, kind, rank, pos): a file's entities, each name once."""
    parts = [
        parsed.select(F.col("id").alias("file"), F.col("ord").alias("file_ord"), F.posexplode(f"entities.{column}").alias("pos", "label")).withColumns({"kind": F.lit(kind), "rank": F.lit(rank)})
        for rank, (column, kind) in enumerate(KINDS)
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    every = every.withColumn("id", entity_id(F.col("file"), F.col("label")))
    first = Window.partitionBy("id").orderBy("rank", "pos")
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def imports(parsed: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """(src, dst, dep, external, file_ord, pos): each import that leads somewhere, parallel ones kept.

    A relative import that meets no node is dropped; any other is first
    looked for beside the file, and is external if it isn't there.
    """
    deps = parsed.select(F.col("id").alias("src"), F.col("ord").alias("file_ord"), F.posexplode("dependencies").alias("pos", "dep"))
    deps = deps.withColumn("target", resolve(dirname(F.col("src")), F.col("dep")))
    known = parsed.select("id").unionByName(entity_ids.select("id")).select(F.col("id").alias("hit"))
    met = deps.join(known, deps.target == known.hit, "left")
    kept = met.where(F.col("hit").isNotNull() | ~is_relative(F.col("dep")))
    return kept.select("src", F.coalesce("hit", "dep").alias("dst"), "dep", F.col("hit").isNull().alias("external"), "file_ord", "pos")


def build_graph(parsed: DataFrame, packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from ``parsed`` records; failed ones leave nothing.

    ``packages`` (name) are the manifest's; an external of just that name is
    marked. Nodes are numbered file by file, entities behind their file and
    externals last by first use; edges likewise.
    """
    parsed = parsed.where(~F.coalesce("error", F.lit(False)))
    inner = entities(parsed)
    links = imports(parsed, inner)
    docs = F.col("entities.docstrings")
    files = parsed.select("id", F.col("ord").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), "dependencies", F.when(F.size(docs) > 0, docs).alias("docstrings"))
    things = inner.select("id", F.col("file_ord").alias("a"), (F.col("rank") + 1).alias("b"), F.col("pos").alias("c"), "label", "kind")
    outside = links.where("external").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("file_ord", "pos")).alias("f"))
    named = packages.select(F.col("name").alias("id")).distinct().withColumn("npm", F.lit(True)) if packages is not None else None
    outside = outside.join(named, "id", "left") if named is not None else outside.withColumn("npm", F.lit(False))
    outside = outside.select(
        "id", (F.lit(1 << 40) + F.col("f.file_ord")).alias("a"), F.lit(0).alias("b"), F.col("f.pos").alias("c"), F.col("id").alias("label"), F.lit(True).alias("external"), F.coalesce("npm", F.lit(False)).alias("npm")
    )
    nodes = files.unionByName(things, True).unionByName(outside, True)
    nodes = _number(nodes, "a", "b", "c", "id").select("id", "ord", "label", "kind", "external", "npm", "dependencies", "docstrings")
    contains = inner.select(F.col("file_ord").alias("a"), (F.col("rank") + 1).alias("b"), F.col("pos").alias("c"), F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relation"))
    edges = contains.unionByName(
        links.select((F.lit(1 << 40) + F.col("file_ord")).alias("a"), F.lit(0).alias("b"), F.col("pos").alias("c"), "src", "dst", F.lit("imports").alias("relationship")), True
    )
    return nodes, _number(edges, "a", "b", "c", "src", "dst").select("ord", "src", "dst", "relation", "relationship")


def _number(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``ord`` that follows ``order``.

    The number packs the order's own parts, so that no single task has to
    see all rows: two of the same parts share it, and are told apart by id.
    """
    a, b, c = (F.col(x).cast("long") for x in order[:3])
    far, near = F.shiftright(a, 40), a.bitwiseAND((1 << 40) - 1)
    return df.withColumn("ord", F.shiftleft(far, 62) + F.shiftleft(near, 27) + F.shiftleft(b, 24) + F.least(c, F.lit((1 << 24) - 1)))
