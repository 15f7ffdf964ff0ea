"""Statistics of a graph given as ``nodes`` and ``edges``.

Neighbours count once however many parallel edges lead to them; edge counts
keep multiplicity. Every function takes DataFrames with at least the columns
of :mod:`depweave.schema` that it uses and returns a DataFrame.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import dirname, fixed, is_entity, is_file, label, parent
from .cycles import cycle_ids
from .query import eccentricity, roots

TOP = 5


def how_many(top: object = TOP, every: bool = False) -> int | None:
    """The k of a top-k from what was asked for: None for all, TOP for 0 and what isn't a number."""
    if every:
        return None
    try:
        return int(float(str(top))) or TOP
    except (ValueError, OverflowError):
        return TOP


def write_stats(stats: dict, path: str | None = None) -> str:
    """The figures as JSON, written to ``path``, whose folders are made, if there is one."""
    text = json.dumps(stats, indent=2, ensure_ascii=False)
    if path is not None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def _files(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_file(F.col("external"), F.col("kind")))


def _long(c: Column) -> Column:
    return c.cast("long")


def _counter(df: DataFrame) -> Callable[[Column], Column]:
    """How many fulfil a condition, by ``times`` where rows have it."""
    if "times" in df.columns:
        return lambda cond: _long(F.coalesce(F.sum(F.when(cond, F.col("times"))), F.lit(0)))
    return lambda cond: _long(F.count_if(cond))


def composition(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes of each sort; a row stands for as many as its ``times`` says, if there is such a column."""
    kind, external = F.col("kind"), F.coalesce("external", F.lit(False))
    count = _counter(nodes)
    return nodes.agg(
        count(is_file(F.col("external"), kind)).alias("files"),
        count(is_entity(kind) & ~external).alias("entities"),
        *(count((kind == k) & ~external).alias(name) for k, name in (("class", "classes"), ("function", "functions"), ("method", "methods"))),
        count(external).alias("externals"),
        count(external & F.coalesce("npm", F.lit(False))).alias("npm_packages"),
    )


def edge_composition(edges: DataFrame) -> DataFrame:
    """One row: edges that contain and others; a row stands for as many as its ``times`` says, if there is such a column."""
    inside, count = F.col("relation").eqNullSafe(F.lit("contains")), _counter(edges)
    return edges.agg(count(~inside).alias("dependency_edges"), count(inside).alias("contains_edges"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) once each, with ``entity`` and ``outside`` of the target."""
    ends = nodes.select(F.col("id").alias("dst"), is_entity(F.col("kind")).alias("entity"), F.coalesce("external", F.lit(False)).alias("outside"))
    return edges.select("src", "dst").distinct().join(ends, "dst")


def _entities_told(tally: DataFrame) -> DataFrame:
    return tally.where(is_entity(F.col("kind"))).select(F.col("src").alias("file"), "n")


def language_breakdown(nodes: DataFrame, edges: DataFrame, tally: DataFrame | None = None) -> DataFrame:
    """Files, distinct dependencies and entities of each language, most files first.

    ``tally`` (src, kind, n) has entities that are counted already and so aren't among ``edges``.
    """
    out = neighbours(nodes, edges).groupBy("src").agg(F.count_if(~F.col("entity")).alias("deps"), F.count_if(F.col("entity")).alias("inner"))
    if tally is not None:
        both = out.unionByName(_entities_told(tally).select(F.col("file").alias("src"), F.lit(0).cast("long").alias("deps"), F.col("n").alias("inner")))
        out = both.groupBy("src").agg(F.sum("deps").alias("deps"), F.sum("inner").alias("inner"))
    name = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("Unknown"))
    per = _files(nodes).select("id", name.alias("language")).join(out, F.col("id") == F.col("src"), "left")
    return (
        per.groupBy("language")
        .agg(_long(F.count("*")).alias("files"), _long(F.coalesce(F.sum("deps"), F.lit(0))).alias("total_deps"), _long(F.coalesce(F.sum("inner"), F.lit(0))).alias("entities"))
        .orderBy(F.desc("files"), "language")
    )


def _top(counts: DataFrame, by: str, k: int | None, order: str = "id") -> DataFrame:
    ranked = counts.orderBy(F.desc(by), order)
    return (ranked.limit(k) if k is not None else ranked).select("id", by)


def most_imported(nodes: DataFrame, edges: DataFrame, k: int | None = TOP, order: str = "id") -> DataFrame:
    """Files by the number of distinct nodes, entities left out, that import them."""
    files = _files(nodes).select("id", *({order} - {"id"}))
    from_ = nodes.where(~is_entity(F.col("kind"))).select(F.col("id").alias("src"))
    pairs = edges.select("src", "dst").distinct().join(from_, "src", "left_semi")
    return _top(files.join(pairs.groupBy(F.col("dst").alias("id")).agg(_long(F.count("*")).alias("dependents")), "id"), "dependents", k, order)


def heaviest_importers(nodes: DataFrame, edges: DataFrame, k: int | None = TOP, order: str = "id") -> DataFrame:
    """Files by the number of distinct nodes, entities left out, that they import."""
    files = _files(nodes).select("id", *({order} - {"id"}))
    to = nodes.where(~is_entity(F.col("kind"))).select(F.col("id").alias("dst"))
    pairs = edges.select("src", "dst").distinct().join(to, "dst", "left_semi")
    return _top(files.join(pairs.groupBy(F.col("src").alias("id")).agg(_long(F.count("*")).alias("dependencies")), "id"), "dependencies", k, order)


def largest_files(nodes: DataFrame, edges: DataFrame, k: int | None = TOP, order: str = "id", tally: DataFrame | None = None) -> DataFrame:
    """Files by their number of entities. ``tally`` is as for :func:`language_breakdown`."""
    files = _files(nodes).select("id", *({order} - {"id"}))
    to = nodes.where(is_entity(F.col("kind"))).select(F.col("id").alias("dst"))
    counted = edges.select("src", "dst").join(to, "dst", "left_semi").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    if tally is not None:
        counted = counted.unionByName(_entities_told(tally).withColumnRenamed("file", "id"))
    return _top(files.join(counted.groupBy("id").agg(_long(F.sum("n")).alias("entities")), "id"), "entities", k, order)


def max_dep_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the largest distance of a file from a file that no file imports; 0 without such."""
    files = _files(nodes).select("id")
    links = file_edges(files, edges)
    return nodes.sparkSession.createDataFrame([(eccentricity(links, roots(files, links)),)], "max_depth long")


def file_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between files, parallel ones kept."""
    return edges.select("src", "dst").join(files.select(F.col("id").alias("src")), "src", "left_semi").join(files.select(F.col("id").alias("dst")), "dst", "left_semi")


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges between files, how many cross communities, and their ratio. Two without a community are in the same."""
    files = _files(nodes)
    joined = edges.select("src", "dst").join(files.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(files.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    counted = joined.agg(_long(F.count_if(~F.col("a").eqNullSafe(F.col("b")))).alias("cross_edges"), _long(F.count("*")).alias("total_edges"))
    return counted.withColumn("cross_ratio", F.when(F.col("total_edges") > 0, F.col("cross_edges") / F.col("total_edges")).otherwise(0.0))


def isolated_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files without a neighbour other than entities, in either direction. A file that imports itself isn't isolated."""
    solid = nodes.where(~is_entity(F.col("kind"))).select("id")
    out = edges.select(F.col("src").alias("id"), "dst").join(solid.select(F.col("id").alias("dst")), "dst", "left_semi").select("id")
    into = edges.select(F.col("dst").alias("id"), "src").join(solid.select(F.col("id").alias("src")), "src", "left_semi").select("id")
    return _files(nodes).select("id").join(out.unionByName(into), "id", "left_anti")


def health_ratios(nodes: DataFrame, edges: DataFrame, tally: DataFrame | None = None) -> DataFrame:
    """One row: distinct dependencies and entities a file, not rounded; 0 without files. ``tally`` is as for :func:`language_breakdown`."""
    total = language_breakdown(nodes, edges, tally).agg(F.sum("files").alias("f"), F.sum("total_deps").alias("d"), F.sum("entities").alias("e"))
    per = lambda c: F.when(F.col("f") > 0, F.col(c) / F.col("f")).otherwise(0.0)
    return total.select(per("d").alias("avg_deps"), per("e").alias("entity_density"))


def directory_breakdown(nodes: DataFrame) -> DataFrame:
    return _files(nodes).groupBy(dirname(F.col("id")).alias("dir")).agg(_long(F.count("*")).alias("files")).orderBy(F.desc("files"), "dir")


def target_stats(nodes: DataFrame, edges: DataFrame, target: str, cycles: DataFrame | None = None) -> DataFrame:
    """One row on a node, none for an unknown id: its sort, inherited attributes, degrees, neighbours and cycles."""
    here = nodes.where(F.col("id") == target).select("id", "label", "kind", "external", "npm", "language", "community")
    entity, outside = is_entity(F.col("kind")), F.coalesce("external", F.lit(False))
    of = nodes.select(F.col("id").alias("parent_id"), F.col("language").alias("parent_language"), F.col("community").alias("parent_community"))
    base = here.withColumn("parent_file", F.when(entity & ~outside, parent(F.col("id")))).join(of, F.col("parent_file") == F.col("parent_id"), "left")
    touching = edges.where((F.col("src") == target) | (F.col("dst") == target))
    degree = touching.agg(_long(F.count_if(F.col("dst") == target)).alias("in_deg"), _long(F.count_if(F.col("src") == target)).alias("out_deg"))
    kinds = nodes.select(F.col("id").alias("other"), is_entity(F.col("kind")).alias("inner"), F.col("kind").alias("other_kind"))
    both = touching.select(F.explode(F.array(F.struct((F.col("src") == target).alias("go"), (F.col("src") == target).alias("ok"), F.col("dst").alias("other")), F.struct(F.lit(False).alias("go"), (F.col("dst") == target).alias("ok"), F.col("src").alias("other")))).alias("e")).select("e.*")
    ends = both.where("ok").select("go", "other").distinct().join(kinds, "other")
    counts = ends.agg(
        _long(F.count_if(F.col("go") & ~F.col("inner"))).alias("dependencies"),
        _long(F.count_if(~F.col("go") & ~F.col("inner"))).alias("dependents"),
        *(_long(F.count_if(F.col("go") & (F.col("other_kind") == k))).alias(n) for k, n in (("class", "classes"), ("function", "functions"), ("method", "methods"))),
        _long(F.count_if(F.col("go") & F.col("inner"))).alias("entities"),
    )
    out = base.crossJoin(F.broadcast(degree)).crossJoin(F.broadcast(counts))  # a row each
    ids = cycle_ids(cycles, target) if cycles is not None else []
    file = ~outside & ~entity
    return out.select(
        "id",
        label(F.col("label"), F.col("id")).alias("label"),
        F.when(outside, "external").when(entity, "entity").otherwise("file").alias("type"),
        F.when(entity & ~outside, F.col("kind")).alias("kind"),
        F.when(outside, F.lit(None)).when(entity, F.col("parent_language")).otherwise(F.nullif(F.col("language"), F.lit(""))).alias("language"),
        F.when(outside, F.coalesce("community", F.lit("dependencies"))).otherwise(F.coalesce("community", "parent_community")).alias("community"),
        "parent_file",
        "in_deg",
        "out_deg",
        (F.col("in_deg") + F.col("out_deg")).alias("total_deg"),
        "dependencies",
        "dependents",
        *(F.when(file, F.col(c)).alias(c) for c in ("classes", "functions", "methods", "entities")),
        ((F.col("dependencies") == 0) & (F.col("dependents") == 0)).alias("is_isolated"),
        F.array(*map(F.lit, ids)).cast("array<int>").alias("cycles"),
        "npm",
    )


def global_stats(nodes: DataFrame, edges: DataFrame, top: int | None = TOP, cycles: DataFrame | None = None, verbose: bool = False, compat: bool = False) -> dict:
    """All figures of a graph as one object, rounded for people.

    ``compat`` leaves the number of communities 0, as some readers expect.
    """
    order = "ord" if "ord" in nodes.columns else "id"
    rows = lambda df: [r.asDict() for r in df.collect()]
    kinds, links, cross, ratios = (rows(df)[0] for df in (composition(nodes), edge_composition(edges), coupling(nodes, edges), health_ratios(nodes, edges)))
    lonely = isolated_files(nodes, edges)
    folders = rows(directory_breakdown(nodes))
    crossing = {"cross_community_edges": cross["cross_edges"], "cross_community_pct": fixed(cross["cross_ratio"] * 100, 1)}
    communities = 0 if compat else _files(nodes).select("community").where("community is not null").distinct().count()
    out = {
        "composition": {**kinds, **links, "communities": communities, "directories": len(folders), **crossing, "total_file_edges": cross["total_edges"]},
        "languages": rows(language_breakdown(nodes, edges)),
        "hotspots": {
            "most_imported": rows(most_imported(nodes, edges, top, order)),
            "heaviest_importers": rows(heaviest_importers(nodes, edges, top, order)),
            "largest_files": rows(largest_files(nodes, edges, top, order)),
        },
        "health": {
            "isolated_files": lonely.count(),
            "avg_deps_per_file": fixed(ratios["avg_deps"], 1),
            "entity_density": fixed(ratios["entity_density"], 2),
            "max_dep_chain": rows(max_dep_chain(nodes, edges))[0]["max_depth"],
            "circular_deps": None if cycles is None else cycles.count(),
            **crossing,
        },
        "directories": folders,
    }
    if verbose:
        out["health"]["isolated_list"] = [r.id for r in lonely.orderBy("id").collect()]
    return out


def language_histogram(files: DataFrame, name: Column) -> DataFrame:
    """Languages by number of files, with their share of all that have one."""
    counted = files.select(name.alias("lang")).where(F.col("lang").isNotNull() & (F.col("lang") != "Unknown")).groupBy("lang").agg(_long(F.count("*")).alias("cnt"))
    return counted.withColumn("ratio", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))
