"""Graphs, cycles, caches and summaries in files."""

from __future__ import annotations

import json
import os
import shutil
from functools import partial
from html import escape
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import VERSION
from ..operators.storage import scratch, stored
from ..schema import CACHE, CYCLES, EDGES, NODES

FOLDER = "graph-out"


class OutsideFolder(Exception):
    """A write was asked for outside the output folder."""


class OutputFolder:
    """Writes only below one folder."""

    def __init__(self, root: str | None = None):
        self.path = os.path.abspath(os.path.join(root or os.getcwd(), FOLDER))

    def place(self, *names: str) -> str:
        target = os.path.abspath(os.path.join(self.path, *names))
        if not target.startswith(self.path + os.sep):
            raise OutsideFolder(f"{target} is not in {self.path}")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        return target

    def write(self, text: str, *names: str) -> str:
        target = self.place(*names)
        aside = f"{target}.part"
        with open(aside, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(aside, target)
        return target

    def clear(self, confirmed: bool) -> bool:
        """Delete the folder and all in it, if that is confirmed; whether there was one."""
        if not confirmed or not os.path.isdir(self.path):
            return False
        shutil.rmtree(self.path)
        return True


_SNAKE = {"semantic_summary": "semanticSummary"}


def _attributes(row: dict, skip: tuple[str, ...]) -> dict:
    return {_SNAKE.get(k, k): v for k, v in row.items() if k not in skip and v is not None}


def graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    """The whole graph as one JSON text, for viewers; tables are better kept as Parquet."""
    order = lambda df, *c: df.orderBy(*[x for x in c if x in df.columns])
    ns = [{"key": r["id"], "attributes": _attributes(r, ("id", "ord"))} for r in (x.asDict(True) for x in order(nodes, "ord", "id").toLocalIterator())]
    es = [{"source": r["src"], "target": r["dst"], "attributes": _attributes(r, ("src", "dst", "ord"))} for r in (x.asDict(True) for x in order(edges, "ord", "src", "dst").toLocalIterator())]
    return json.dumps({"options": {"type": "mixed", "multi": True, "allowSelfLoops": True}, "attributes": {}, "nodes": ns, "edges": es}, indent=2, ensure_ascii=False)


_ATTRIBUTES = (
    "label string, kind string, external boolean, npm boolean, dependencies array<string>, docstrings array<string>, language string, "
    "community string, color string, size double, x double, y double, semanticSummary string"
)
_GRAPH = (
    f"nodes array<struct<key: string, attributes: struct<{_ATTRIBUTES.replace(' ', ': ').replace(',:', ',')}>>>, "
    "edges array<struct<source: string, target: string, attributes: struct<relation: string, relationship: string>>>"
)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of a graph in JSON; None without a file, an error if it isn't JSON."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        json.load(f)
    held = spark.read.schema(_GRAPH).option("multiLine", True).json(path)
    nodes = held.select(F.posexplode("nodes").alias("ord", "n")).select(F.col("n.key").alias("id"), F.col("ord").cast("long").alias("ord"), *(F.col(f"n.attributes.{a}").alias("semantic_summary" if a == "semanticSummary" else a) for a in (p.split()[0] for p in _ATTRIBUTES.split(", "))))
    edges = held.select(F.posexplode("edges").alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.attributes.relation").alias("relation"), F.col("e.attributes.relationship").alias("relationship"))
    return nodes.select(*(p.split()[0] for p in NODES.split(", "))), edges.select(*(p.split()[0] for p in EDGES.split(", ")))


def cycles_json(cycles: DataFrame) -> str:
    return json.dumps([r.asDict(True) for r in cycles.orderBy("id").collect()], indent=2, ensure_ascii=False)


def read_cycles(spark: SparkSession, path: str) -> DataFrame | None:
    """Cycles from a list, or an object that holds one as ``cycles``; None on any failure."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        rows = held["cycles"] if isinstance(held, dict) else held
        text = [(json.dumps(r),) for r in rows]
        one = spark.createDataFrame(text, "j string").select(F.from_json("j", CYCLES).alias("c"))
        return one.select("c.*")
    except (OSError, ValueError, KeyError, TypeError):
        return None


def write_cache(cache: DataFrame, path: str) -> None:
    """The parse cache as Parquet with its version. It is made whole before the old one goes, as it may be read from that."""
    with scratch(cache.sparkSession):
        stored(cache).withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The parse cache; None if it is missing, broken or of another version."""
    try:
        held = spark.read.schema(f"version int, {CACHE}").parquet(path)
        if not held.where(F.coalesce(F.col("version") != VERSION, F.lit(True))).isEmpty():
            return None
        return held.drop("version")
    except Exception:  # noqa: BLE001  a cache that can't be read is as good as none
        return None


def summary_markdown(sections: list[tuple[int, str]], title: str = "Semantic summary") -> str:
    """Summaries in the order of their clusters."""
    return f"# {title}\n\n" + "".join(f"## Cluster {i + 1}\n\n{text}\n\n" for i, text in sorted(sections))


def write_retry(folder: OutputFolder, failed: list[dict], name: str = ".explain-retry.json") -> None:
    """What to try again; the file goes when nothing is left."""
    if failed:
        folder.write(json.dumps(failed, indent=2), name)
    elif os.path.exists(target := folder.place(name)):
        os.remove(target)


def read_retry(folder: OutputFolder, name: str = ".explain-retry.json") -> list[dict]:
    try:
        with open(folder.place(name), encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return []


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{margin:0;font:13px sans-serif;display:flex;height:100vh}}aside{{width:260px;padding:10px;overflow:auto;border-right:1px solid #ccc}}canvas{{flex:1}}li{{cursor:pointer;list-style:none}}.off{{opacity:.35}}</style></head>
<body><aside><h3>{title}</h3><p id="stats"></p><input id="find" placeholder="find"><ul id="hits"></ul><ul id="legend"></ul><p id="info"></p></aside><canvas id="view"></canvas>
<script type="application/json" id="graph">{graph}</script><script>
const g = JSON.parse(document.getElementById('graph').textContent), by = new Map(), hidden = new Set(), $ = id => document.getElementById(id);
const entity = a => ['class', 'function', 'method', 'entity'].includes(a.kind);
g.nodes.forEach((n, i) => {{ const a = n.attributes; by.set(n.key, {{ key: n.key, a, x: a.x ?? (i * 37) % 100, y: a.y ?? (i * 61) % 100, deg: 0, near: [] }}); }});
for (const e of g.edges) {{ const s = by.get(e.source), t = by.get(e.target); if (s && t) {{ s.deg++; t.deg++; s.near.push(t); t.near.push(s); }} }}
const all = [...by.values()], links = g.edges.map(e => [by.get(e.source), by.get(e.target), e.attributes]).filter(l => l[0] && l[1]);
for (const n of all) {{ n.r = entity(n.a) ? 5 : n.a.external ? 8 : Math.max(10, Math.min(25, 3 * n.deg + 5)); n.group = n.a.community || 'other'; n.name = n.a.label || n.key; }}
const cell = 12, steps = Math.max(10, Math.min(300, Math.round(3e6 / (all.length + 1))));
for (let step = 0; step < steps; step++) {{
  const grid = new Map(), cool = 1 - step / steps;
  for (const n of all) {{ const k = Math.floor(n.x / cell) + ',' + Math.floor(n.y / cell); (grid.get(k) || grid.set(k, []).get(k)).push(n); n.dx = (50 - n.x) * 0.002; n.dy = (50 - n.y) * 0.002; }}
  for (const n of all) for (let i = -1; i < 2; i++) for (let j = -1; j < 2; j++) for (const m of grid.get((Math.floor(n.x / cell) + i) + ',' + (Math.floor(n.y / cell) + j)) || []) {{ const x = n.x - m.x, y = n.y - m.y, d = x * x + y * y + 0.1; if (m !== n) {{ n.dx += x / d; n.dy += y / d; }} }}
  for (const [s, t] of links) {{ const x = t.x - s.x, y = t.y - s.y; s.dx += x * 0.02; s.dy += y * 0.02; t.dx -= x * 0.02; t.dy -= y * 0.02; }}
  for (const n of all) {{ n.x += Math.max(-2, Math.min(2, n.dx)) * cool; n.y += Math.max(-2, Math.min(2, n.dy)) * cool; }}
}}
const view = $('view'), pen = view.getContext('2d'); let chosen = null, at = null;
const shown = n => !hidden.has(n.group);
function draw() {{
  view.width = view.clientWidth; view.height = view.clientHeight;
  const seen = all.filter(shown); if (!seen.length) return;
  const xs = seen.map(n => n.x), ys = seen.map(n => n.y), low = v => v.reduce((a, b) => Math.min(a, b)), high = v => v.reduce((a, b) => Math.max(a, b));
  const x0 = low(xs), y0 = low(ys), scale = 0.9 * Math.min(view.width / (high(xs) - x0 || 50), view.height / (high(ys) - y0 || 50));
  at = n => [(n.x - x0) * scale + view.width * 0.05, (n.y - y0) * scale + view.height * 0.05];
  for (const [s, t, a] of links) if (shown(s) && shown(t)) {{ pen.strokeStyle = s.a.color || '#64748b'; pen.globalAlpha = chosen && s !== chosen && t !== chosen ? 0.1 : 0.5; pen.lineWidth = a.relation === 'contains' ? 1 : 2; pen.setLineDash(a.relation === 'contains' ? [3, 3] : []); pen.beginPath(); pen.moveTo(...at(s)); pen.lineTo(...at(t)); pen.stroke(); }}
  pen.setLineDash([]);
  for (const n of seen) {{ pen.globalAlpha = chosen && n !== chosen && !chosen.near.includes(n) ? 0.2 : 1; pen.fillStyle = n.a.color || '#94a3b8'; pen.beginPath(); pen.arc(...at(n), n.r / 2, 0, 7); pen.fill(); if (n.r > 12 || n === chosen) {{ pen.fillStyle = '#222'; const p = at(n); pen.fillText(n.name, p[0] + n.r / 2, p[1]); }} }}
}}
function choose(n) {{ chosen = n; $('info').textContent = n ? n.name + ': ' + n.near.length + ' neighbours. ' + (n.a.semanticSummary || '') : ''; draw(); }}
view.onclick = e => {{ let best = null, far = 400; for (const n of all.filter(shown)) {{ const p = at(n), d = (p[0] - e.offsetX) ** 2 + (p[1] - e.offsetY) ** 2; if (d < far) {{ far = d; best = n; }} }} choose(best); }};
$('find').oninput = () => {{ const text = $('find').value.toLowerCase(); $('hits').replaceChildren(...(text ? all.filter(n => n.name.toLowerCase().includes(text)).slice(0, 15) : []).map(n => {{ const li = document.createElement('li'); li.textContent = n.name; li.onclick = () => choose(n); return li; }})); }};
const groups = new Map(); for (const n of all) groups.set(n.group, (groups.get(n.group) || 0) + 1);
$('legend').replaceChildren(...[...groups].sort((a, b) => a[0].localeCompare(b[0])).map(([name, n]) => {{ const li = document.createElement('li'); li.textContent = name + ' (' + n + ')'; li.onclick = () => {{ hidden.has(name) ? hidden.delete(name) : hidden.add(name); li.classList.toggle('off'); draw(); }}; return li; }}));
$('stats').textContent = all.length + ' nodes, ' + links.length + ' edges'; onresize = draw; draw();
</script></body></html>
"""


def graph_html(nodes: DataFrame, edges: DataFrame, title: str = "Dependency graph") -> str:
    """A page that carries the graph and draws it: laid out by forces, with a legend, a search and the neighbours of what is clicked."""
    return PAGE.format(title=escape(title), graph=graph_json(nodes, edges).replace("</", "<\\/"))


def server(folder: OutputFolder, port: int = 0) -> ThreadingHTTPServer:
    """A server of the output folder alone, on this machine; ``serve_forever`` and ``shutdown`` are its own."""
    return ThreadingHTTPServer(("127.0.0.1", port), partial(SimpleHTTPRequestHandler, directory=folder.path))
