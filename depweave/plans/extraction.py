"""Extraction queries: sources written from the suppliers' keys, and what must be found in each.

``@k`` stands for a supplier's key and ``@n`` for its nation's. A language
has two texts, for even and odd keys, each with its dependencies, classes,
functions, methods, docstrings and flat entities, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from ..sources.adapters import table
from .registry import register

SORTS = ("dependencies", "classes", "functions", "methods", "docstrings", "flat")

_LONG_TYPE = "{ " + " ".join(f"f{i}: Map<string, (a: number) => void>;" for i in range(20)) + " }"
_LONG_INIT = ", ".join(f"m{i}(static_cast<std::map<int, int>>(a)), b{i}{{a}}" for i in range(25))
_LONG_THROWS = ", ".join(f"some.very.long.name.Problem{i}" for i in range(25))

#: name -> (extension, ((text, {sort: names}), (text, {sort: names})))
LANGUAGES: dict[str, tuple[str, tuple[tuple[str, dict[str, list[str]]], ...]]] = {
    "javascript": (".js", (
        (
            """import { a@k } from './m@k';
import D@n, * as all from "pkg@n";
const l = require('lib@k'); import('lazy@n');
export { q } from 'not@k'; // import x from 'comment'
const s = "require('string')", t = `require('template')`, p = /require('pattern')/;
/** Doc @k. */
export class App@k extends Base { constructor(a) { super(a); } async run@n(x) { if (x) { go(); } } #hide@k() {} }
function plain@k(a) { function inner@n() {} return inner@n; }
const arrow@k = () => {}; let fn@n = function () {}; var old@k = () => {};
""",
            {"dependencies": ["./m@k", "pkg@n", "lib@k", "lazy@n"], "classes": ["App@k"], "functions": ["plain@k", "inner@n", "arrow@k", "fn@n"], "methods": ["constructor", "run@n", "#hide@k"], "docstrings": ["/** Doc @k. */"]},
        ),
        (
            "import './side@k.css';\nexport default async function main@k() {}\nconst one@n = x => x, two = 1;\nconst Expr = class Hidden {};\nobj.require('nor@k');\n",
            {"dependencies": ["./side@k.css"], "functions": ["main@k", "one@n"]},
        ),
    )),
    "typescript": (".ts", (
        (
            """import type { T@k } from 'types@n';
import './side@k';
const k@k = (a: number): { x: number } => ({ x: a });
var old@n = (a: number): string => 'x';
const far@k = async <T extends { a: 1 }>(a: T): Promise<LONG> => null;
class Box@k<T> { get@n(): { v: T } { return null; } #no() {} wide@n(a: LONG): LONG | null { return f(a); } map@k<U>(f: (t: T) => U): Box@k<U> { return f(null); } only(): void; }
abstract class Shape@k {}
/** Typed @n */
interface I@n { m(): void; }
""".replace("LONG", _LONG_TYPE),
            {"dependencies": ["types@n", "./side@k"], "classes": ["Box@k"], "functions": ["k@k", "old@n", "far@k"], "methods": ["get@n", "wide@n", "map@k"], "docstrings": ["/** Typed @n */"]},
        ),
        (
            "const typed@k: (a: number) => void = async (a) => {};\nconst not@k = (1 + 2);\nfunction f@n<T>(x: T): x is { a: 1 } { return g(x); }\nconst lib = require('lib@k');\n",
            {"dependencies": ["lib@k"], "functions": ["typed@k", "f@n"]},
        ),
    )),
    "python": (".py", (
        (
            '''"""Module @k."""
import os, a.b@n as z
from .utils@k import helper
from . import x
class C@k:
    """Doc."""
    def run@n(self):
        def inner@k(): pass
    @staticmethod
    def made@k(): pass
async def free@n(): pass
''',
            {"dependencies": ["os", "a.b@n", ".utils@k", "."], "classes": ["C@k"], "functions": ["inner@k", "free@n"], "methods": ["run@n", "made@k"], "docstrings": ['"""Module @k."""', '"""Doc."""']},
        ),
        ("import far@k\nclass Half@k:\n    def go@n(self):\n        return (\ndef last@k(:\n", {"dependencies": ["far@k"], "classes": ["Half@k"], "functions": ["last@k"], "methods": ["go@n"]}),
    )),
    "cpp": (".cpp", (
        (
            """#include <vector@k>
#include "my/h@n.h"
// note @k
namespace ns@k { class Big@k { public: Big@k(int a) : INIT { go(); } int get@n() const { return 1; } int only(); }; int deep@n() { return 0; } }
void Big@k::set@k(int x) noexcept { }
int free@k(int a);
int main@n() { return free@k(1); }
struct S@k { int in() { return 1; } };
""".replace("INIT", _LONG_INIT),
            {"dependencies": ["vector@k", "my/h@n.h"], "classes": ["Big@k"], "functions": ["ns@k", "deep@n", "main@n"], "methods": ["Big@k", "get@n", "set@k"], "docstrings": ["// note @k"]},
        ),
        ('/* "class No" */\nauto far@k(int a) -> std::map<int, int> { return f(a); }\nenum class E@n { A };\ntemplate <class T> T same@n(T t) { return t; }\n', {"functions": ["far@k", "same@n"], "docstrings": ['/* "class No" */']}),
    )),
    "java": (".java", (
        (
            """import java.util.List@n;
import org.x@k.*;
/** Doc @k */
public class A@k { A@k(int a) throws LONG { go(); } int run@n(int b) throws LONG { return c(b); } }
interface I@n { int m@k() throws LONG; }
""".replace("LONG", _LONG_THROWS),
            {"dependencies": ["java.util.List@n", "org.x@k"], "classes": ["A@k", "I@n"], "functions": ["A@k", "m@k"], "methods": ["run@n"], "docstrings": ["/** Doc @k */"]},
        ),
        ('class B@k { String s = "class No { }"; void each@n(List<Map<String, Integer>> a) { for (int i = 0; i < 3; i++) { put(i); } } }\n', {"classes": ["B@k"], "methods": ["each@n"]}),
    )),
    "go": (".go", (
        ('package main\nimport (\n\t"fmt"\n\tx "a/b@k"\n)\nimport "c@n"\ntype T@k struct { a int }\ntype (\n\tU@n interface { M() }\n)\nfunc F@k(a int) int { return a }\nfunc (t *T@k) M@n() {}\n', {"dependencies": ["fmt", "a/b@k", "c@n"], "classes": ["T@k", "U@n"], "functions": ["F@k"], "methods": ["M@n"]}),
        ("package p@k\n// func No() {}\nvar s = `func Nor() {}`\nfunc G@n[T any](a T) {}\n", {"functions": ["G@n"]}),
    )),
    "rust": (".rs", (
        ("use std::io@k::{self, Read};\nextern crate serde@n;\npub struct S@k;\nenum E@n { A }\ntrait T@k { fn t@n(&self); }\nimpl T@k for S@k { fn run@n(&self) { let c = 'x'; } }\nfn free@k() {}\n", {"dependencies": ["std::io@k::{self, Read}", "serde@n"], "flat": ["S@k", "E@n", "T@k", "S@k", "run@n", "free@k"]}),
        ('// struct No;\nfn only@k() { let s = "fn nor() {}"; }\n', {"flat": ["only@k"]}),
    )),
    "css": (".css", (
        ('@import "a@k.css";\n@import url("b@n.css");\n/* url(no.png) */\n.x { background: url("c@k.png"), url(d@n.png); }\n.y { background: url(d@n.png); }\n', {"dependencies": ["a@k.css", "b@n.css", "c@k.png", "d@n.png"]}),
        (".z { color: red }\n", {}),
    )),
    "html": (".html", (
        ('<html><head><link rel="x" href="a@k.css"><script src="s@k.js">var t = \'<img src="no.png">\';</script></head><body><!-- <img src="c.png"> --><img src=\'i@n.png\' alt=""><a href="not@k">x</a></body></html>', {"dependencies": ["a@k.css", "i@n.png", "s@k.js"]}),
        ("<p>nothing @k</p>", {}),
    )),
}


def sources(s: SparkSession, d: str, name: str) -> DataFrame:
    """(path, ord, content): a file for each supplier."""
    ext, ((even, _), (odd, _)) = LANGUAGES[name]
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.when(key % 2 == 0, even).otherwise(odd)
    text = F.replace(F.replace(text, F.lit("@k"), key.cast("string")), F.lit("@n"), nation.cast("string"))
    return table(s, d, "supplier").select(F.concat(F.lit("/src/f"), key, F.lit(ext)).alias("path"), key.cast("long").alias("ord"), F.encode(text, "UTF-8").alias("content"))


def found(s: SparkSession, d: str, name: str) -> DataFrame:
    """(id, sort, pos, name) of all that extraction finds."""
    parsed = extract.parse_files(sources(s, d, name))
    lists = [F.struct(F.lit(sort).alias("sort"), (F.col("dependencies") if sort == "dependencies" else F.col(f"entities.{sort}")).alias("names")) for sort in SORTS]
    each = parsed.select("id", F.explode(F.array(*lists)).alias("l"))
    return each.select("id", "l.sort", F.posexplode("l.names").alias("pos", "name")).select("id", "sort", F.col("pos").cast("long").alias("pos"), "name")


def expected(name: str) -> str:
    ext, texts = LANGUAGES[name]
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = [f"({odd}, '{sort}', {pos}, {quoted(n)})" for odd, (_, held) in enumerate(texts) for sort, names in held.items() for pos, n in enumerate(names)]
    return (
        f"SELECT '/src/f' || s_suppkey || '{ext}' AS id, sort, pos::BIGINT AS pos, replace(replace(name, '@k', s_suppkey::VARCHAR), '@n', s_nationkey::VARCHAR) AS name "
        f"FROM supplier JOIN (VALUES {', '.join(rows)}) v(odd, sort, pos, name) ON s_suppkey % 2 = odd"
    )


def _query(name: str):
    def run(s, d):
        return found(s, d, name)

    run.__name__ = f"extract_{name}"
    return run


for _name in LANGUAGES:
    register(expected(_name))(_query(_name))
