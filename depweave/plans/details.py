"""Queries of single expressions and of whole operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import languages as L
from ..operators import build, cache, cycles, enrich, extract, stats, ui
from ..operators.storage import few, stored, unsent
from ..sources import adapters as A
from ..sources.adapters import table
from .extraction import sources
from .registry import PARTS, PARTS38, SUPPLY, _page_path, _page_records, _parts, _snapshots, _supply, register

# expressions

_EXTENSIONS = {ext: name for ext, name in L.LANGUAGE_OF.items()}
_NAMES = ["a.js", "B.TSX", "c.py", ".js", "d", "e.tar.rs", "f.HTML", "g.unknown"]


@register(
    "SELECT s_suppkey, name, CASE lower(regexp_extract(name, '^.+([.][^.]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in _EXTENSIONS.items()) + " ELSE 'Unknown' END AS language "
    f"FROM (SELECT s_suppkey, ({_NAMES})[s_suppkey % 8 + 1] AS name FROM supplier)"
)
def language_of_file(s, d):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % 8).cast("int"))
    return table(s, d, "supplier").select("s_suppkey", name.alias("name")).withColumn("language", L.language(C.extension(F.concat(F.lit("/"), "name"))))


@register("SELECT page_id, CASE WHEN starts_with(p, '/a/') THEN substr(p, 4) ELSE '../' || substr(p, 2) END AS near FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/a/x/' || page_id ELSE '/b/' || page_id END AS p FROM pages)")
def relative_paths(s, d):
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/a/x/"), "page_id")).otherwise(F.concat(F.lit("/b/"), "page_id"))
    return table(s, d, "pages").select("page_id", C.relative_path(path, "/a").alias("near"))


@register("SELECT '/root/src' AS root, '/' AS top, '' AS nothing")
def common_roots(s, d):
    keys = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    below = keys.select(F.concat(F.lit("/root/src/d"), F.col("k") % 3, F.lit("/f"), "k").alias("path"))
    apart = keys.select(F.concat(F.lit("/d"), F.col("k") % 2, F.lit("/f"), "k").alias("path"))
    return s.createDataFrame([(C.common_root(below), C.common_root(apart), C.common_root(below.where("false")))], "root string, top string, nothing string")


@register("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'a' || s_suppkey || '|c|b' WHEN 1 THEN 'a' || s_suppkey || '|z' ELSE 'k' || s_suppkey END AS turned FROM supplier")
def cycle_rotation(s, d):
    key = F.col("s_suppkey")
    a = F.concat(F.lit("a"), key)
    nodes = F.when(key % 3 == 0, F.array(F.lit("c"), F.lit("b"), a)).when(key % 3 == 1, F.array(F.lit("z"), a)).otherwise(F.array(F.concat(F.lit("k"), key)))
    return table(s, d, "supplier").select("s_suppkey", C.rotation(nodes).alias("turned"))


@register("SELECT s_suppkey, s_name AS text FROM supplier")
def strip_quotes(s, d):
    quote = F.when(F.col("s_suppkey") % 2 == 0, "'").otherwise('"')
    return table(s, d, "supplier").select("s_suppkey", C.strip_quotes(F.concat(quote, "s_name", quote)).alias("text"))


@register(SUPPLY + """
SELECT id, 'yellow' AS color, id AS text FROM supply_externals UNION ALL SELECT id, 'cyan', id FROM supply_files
UNION ALL SELECT dst, CASE kind WHEN 'class' THEN 'green' WHEN 'function' THEN 'magenta' ELSE 'cyan' END, CASE kind WHEN 'method' THEN dst ELSE label END FROM supply_contains""")
def node_display(s, d):
    shown = C.display(F.col("id"), F.col("label"), F.col("kind"), F.col("external"))
    return A.supply_nodes(s, d).select("id", shown.alias("d")).select("id", "d.color", "d.text")


@register("SELECT s_suppkey, (s_suppkey % 5 > 2) OR (s_suppkey % 5 = 2 AND s_suppkey % 11 > 7) AS newer FROM supplier")
def versions(s, d):
    key = F.col("s_suppkey")
    return table(s, d, "supplier").select("s_suppkey", C.newer(F.concat_ws(".", key % 5, key % 11, F.lit(0)), F.lit("2.7.0")).alias("newer"))


@register("SELECT page_id, replace(replace(replace(replace(substr(html, 1, 400), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM pages")
def html_escape(s, d):
    return table(s, d, "pages").select("page_id", ui.escape(F.substring("html", 1, 400)).alias("safe"))


# building and enriching as a whole

_BUILT = """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s(?:[^>"]|"[^"]*")*?href="([^"]*)"', 1)) AS h FROM pages),
r AS (SELECT '/site/' || page_id AS src, length(h) % 2 = 0 AS near, '/site/' || ((length(h) * 37 + ascii(substr(h, 2, 1))) % 400) AS target, 'pkg' || h AS dep FROM l),
p AS (SELECT '/site/' || page_id AS id FROM pages)
"""


@register(_BUILT + """
SELECT id, FALSE AS external, NULL AS label, NULL::BOOLEAN AS npm FROM p UNION ALL
SELECT DISTINCT dep, TRUE, dep, length(dep) % 3 = 0 FROM r WHERE NOT near""")
def build_nodes(s, d):
    records = _page_records(s, d)
    named = records.select(F.explode("dependencies").alias("name")).where("name not like './%' and length(name) % 3 = 0").distinct()
    nodes, _ = build.build_graph(records, named)
    return nodes.select("id", F.coalesce("external", F.lit(False)).alias("external"), "label", "npm")


@register(_BUILT + "SELECT src, CASE WHEN near THEN target ELSE dep END AS dst, 'imports' AS relationship, NULL AS relation FROM r WHERE NOT near OR target IN (SELECT id FROM p)")
def build_edges(s, d):
    _, edges = build.build_graph(_page_records(s, d))
    return edges.select("src", "dst", "relationship", "relation")


@register("SELECT '/src/f' || s_suppkey || '.rs::' || replace(name, '@k', s_suppkey::VARCHAR) AS id, 'entity' AS kind FROM supplier JOIN (VALUES (1, 'only@k'), (0, 'S@k'), (0, 'T@k'), (0, 'free@k')) v(odd, name) ON s_suppkey % 2 = odd "
          "UNION ALL SELECT '/src/f' || s_suppkey || '.rs::' || v || s_nationkey, 'entity' FROM supplier, (VALUES ('E'), ('run')) w(v) WHERE s_suppkey % 2 = 0")
def flat_entities(s, d):
    return build.entities(extract.parse_files(sources(s, d, "rust"))).select("id", "kind")


@register(PARTS + """
SELECT f.id, f.label, 'Unknown' AS language, greatest(5, least(15, coalesce(k, 0)))::DOUBLE AS size FROM part_files f
LEFT JOIN (SELECT id, count(*) AS k FROM (SELECT src AS id FROM part_edges UNION ALL SELECT dst FROM part_edges) GROUP BY id) c ON c.id = f.id""")
def enrich_files(s, d):
    return enrich.enrich(*_parts(s, d)).select("id", "label", "language", "size")


@register(SUPPLY + """
SELECT id, 'dependencies' AS community, '#2d6a4f' AS color, greatest(5, least(15, coalesce(k, 0)))::DOUBLE AS size FROM supply_externals
LEFT JOIN (SELECT dst, count(*) AS k FROM supply_imports GROUP BY dst) c ON c.dst = id
UNION ALL SELECT dst, 'inherited', '#6a2d6a', 3 FROM supply_contains""")
def enrich_others(s, d):
    """Externals and entities; an entity has the community of its file, whatever that is."""
    out = enrich.enrich(A.supply_nodes(s, d).withColumn("ord", F.lit(0).cast("long")), A.supply_imports(s, d), tally=A.supply_tally(s, d))
    files = few(stored(out.where("not external and kind is null").select(F.col("id").alias("parent"), F.col("community").alias("theirs"))))
    held = out.where("external or kind is not null").join(files, C.parent(F.col("id")) == F.col("parent"), "left")
    return held.select("id", F.when(~F.col("external") & (F.col("community") == F.col("theirs")), "inherited").otherwise(F.col("community")).alias("community"), "color", "size")


@register(PARTS + """, reach(root, id, depth) AS (SELECT id, id, 0 FROM part_files WHERE id NOT IN (SELECT dst FROM part_edges) UNION SELECT root, e.dst, depth + 1 FROM reach r JOIN part_edges e ON e.src = r.id WHERE depth < 30)
SELECT (SELECT count(*) FROM part_files) AS files, (SELECT count(*) FROM part_edges) AS edges, (SELECT count(DISTINCT community) FROM part_files) AS communities,
  (SELECT count(*) FROM part_edges e JOIN part_files a ON e.src = a.id JOIN part_files b ON e.dst = b.id WHERE a.community <> b.community) AS crossing,
  (SELECT count(*) FROM part_files f WHERE NOT EXISTS (SELECT 1 FROM part_edges WHERE src = f.id OR dst = f.id)) AS isolated,
  (SELECT max(depth)::BIGINT FROM (SELECT root, id, min(depth) AS depth FROM reach GROUP BY root, id)) AS max_depth, 3::BIGINT AS top, NULL::BIGINT AS circular""")
def global_stats(s, d):
    told = stats.global_stats(*_parts(s, d), top=stats.how_many("3"))
    kinds, health = told["composition"], told["health"]
    row = (kinds["files"], kinds["dependency_edges"], kinds["communities"], health["cross_community_edges"], health["isolated_files"], health["max_dep_chain"], len(told["hotspots"]["most_imported"]), health["circular_deps"])
    return s.createDataFrame([row], "files long, edges long, communities long, crossing long, isolated long, max_depth long, top long, circular long")


# lists of a viewer

@register(PARTS + "SELECT community, count(*) AS nodes FROM part_files WHERE community NOT IN ('dependencies', 'entities') GROUP BY community")
def ui_legend(s, d):
    return ui.legend(A.part_nodes(s, d)).select("community", "nodes")


@register("SELECT min(x) - 0.05 * (max(x) - min(x)) AS min_x, min(y) - 50 AS min_y, (max(x) - min(x)) + 0.05 * (max(x) - min(x)) * 2 AS range_x, 100.0::DOUBLE AS range_y FROM (SELECT s_suppkey::DOUBLE AS x, 7::DOUBLE AS y FROM supplier)")
def ui_bounds(s, d):
    return ui.bounds(table(s, d, "supplier").select(F.col("s_suppkey").cast("double").alias("x"), F.lit(7.0).alias("y")))


@register(PARTS38 + """, reach(root, id) AS (SELECT src, dst FROM part_edges UNION SELECT root, e.dst FROM reach r JOIN part_edges e ON e.src = r.id)
SELECT (SELECT count(*) > 0 FROM reach WHERE root = id) AS found, TRUE AS closed, TRUE AS linked, TRUE AS on_cycles, TRUE AS told_once, TRUE AS of_target""")
def cycle_overlay(s, d):
    """Cycles against what holds for any: closed, along edges, among nodes that lead to themselves, no rotation twice, found again by a member."""
    nodes, edges = _parts(s, d, 38)
    held = cycles.detect_cycles(nodes, edges).cache()
    steps = held.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst")).distinct()
    mine, lines = ui.in_cycles(nodes, edges, held)
    ids = F.transform("files", lambda f: f["id"])
    turned = held.select(C.rotation(F.slice(ids, F.lit(1), F.col("size"))).alias("t"))
    first = held.select("id", F.element_at("files", 1)["id"].alias("file")).orderBy("id").first()
    row = (
        held.count() > 0,
        held.where(F.element_at(ids, 1) != F.element_at(ids, -1)).isEmpty(),
        steps.join(unsent(edges), ["src", "dst"], "left_anti").isEmpty() and lines.select("src", "dst").distinct().count() == steps.count(),
        mine.select("id").exceptAll(cycles.cyclic_nodes(nodes, edges)).isEmpty(),
        turned.count() == turned.distinct().count(),
        first is None or first.id in cycles.cycle_ids(held, first.file),
    )
    return s.createDataFrame([row], "found boolean, closed boolean, linked boolean, on_cycles boolean, told_once boolean, of_target boolean")


@register(PARTS38 + """, reach(root, id) AS (SELECT src, dst FROM part_edges UNION SELECT root, e.dst FROM reach r JOIN part_edges e ON e.src = r.id)
SELECT DISTINCT a.root AS id, max(a.id) OVER (PARTITION BY a.root) AS component FROM reach a JOIN reach b ON a.root = b.id AND a.id = b.root WHERE a.root <> a.id OR EXISTS (SELECT 1 FROM reach c JOIN reach e ON c.id = e.root AND e.id = c.root WHERE c.root = a.root AND c.id <> a.root)""")
def strong_components(s, d):
    nodes, edges = _parts(s, d, 38)
    return cycles.strong_components(cycles._links(nodes, edges).select("src", "dst"))


@register("SELECT 'd' || doc_id AS path, doc_id % 7 = 0 AS failed FROM documents WHERE doc_id % 5 <> 4")
def cache_keeps_failures(s, d):
    now, _, _ = _snapshots(s, d)
    fresh = now.select(F.col("path").alias("id"), (F.substring("path", 2, 30).cast("long") % 7 == 0).alias("error"))
    nothing = s.createDataFrame([], "path string, mtime_ms double, size long, data struct<id: string, error: boolean>")
    return cache.updated_cache(nothing, now, fresh).select("path", F.col("data.error").alias("failed"))
