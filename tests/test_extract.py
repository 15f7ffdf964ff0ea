import pytest

from depweave.operators import extract as X


def test_script_imports():
    src = """
    import { foo } from 'bar';
    import React, * as all from "react";
    import './side-effect.css';
    const l = require('lodash'); import('dynamic').then(x => x);
    export { a } from 'not-this';
    obj.require('nor-this'); // require('comment')
    const s = "import x from 'string'"; const t = `require('template')`; const p = /require('pattern')/;
    """
    deps, _ = X.javascript(src)
    assert deps == ["bar", "react", "./side-effect.css", "lodash", "dynamic"]


def test_script_entities():
    src = """
    /** Doc of App. */
    export class App extends Base { constructor(a, b = {}) { super(); } async run(x) { if (x) { go(); } } static make() {} get name() { return 1; } #secret() {} }
    function plain(a) { function nested() {} return nested; }
    export default async function main() {}
    const arrow = () => {}, other = 1; let fn = function () {}; var old = () => {};
    const wrapped = async (a, { b }) => { return { inline(c) { return c; } }; };
    const one = x => x; const Expr = class Hidden {};
    /* plain comment */ // line
    """
    deps, got = X.javascript(src)
    assert got["classes"] == ["App"] and got["functions"] == ["plain", "nested", "main", "arrow", "fn", "wrapped", "one"]
    assert got["methods"] == ["constructor", "run", "make", "name", "#secret", "inline"] and got["docstrings"] == ["/** Doc of App. */"]


def test_broken_script():
    deps, got = X.javascript("const x = ;;; `${ '")
    assert deps == [] and got["classes"] == []


def test_typed_script():
    src = """
    import type { X } from 'types';
    import React from 'react';
    class Box<T> implements I { private v: T; get(): T { return this.v; } #hidden() {} map<U>(f: (t: T) => U): Box<U> { return null; } }
    var old = (a: number): string => 'x';
    const typed: Handler = async (a) => {};
    abstract class Shape {}
    const el = <div className="a" />;
    """
    deps, got = X.typescript(src)
    assert deps == ["types", "react"] and got["classes"] == ["Box"] and got["methods"] == ["get", "map"] and got["functions"] == ["old", "typed"]


def test_types_of_any_length():
    wide = "{ " + " ".join(f"field{i}: Map<string, (a: number) => void>;" for i in range(60)) + " }"
    src = f"""
    const k = (a: number): {{ x: number }} => ({{ x: a }});
    const far = async <T extends {{ a: 1 }}>(a: T, b = (1 + 2)): Promise<{wide}> => null;
    const held: (a: {wide}) => void = (a) => {{}};
    const not = (a + b); const nor = (cond) ? (x): y; const plain: {{ f: () => void }} = make(() => 1);
    class C {{
      near(): {{ x: number }} {{ return null; }}
      wide(a: {wide}): {wide} | Array<{wide}> {{ return null; }}
      generic<T extends Map<string, (x: T) => void>>(x: T): asserts x is {{ a: 1 }} {{ call(x); }}
      declared(): {{ x: number }};
      {"static " + " " * 400 + "async"} spaced() {{ if (a) {{ b(); }} }}
      field = (a) => {{ run(a); }};
    }}
    """
    _, got = X.typescript(src)
    assert got["functions"] == ["k", "far", "held"] and got["methods"] == ["near", "wide", "generic", "spaced"] and got["classes"] == ["C"]


def test_long_heads():
    init = ", ".join(f"member{i}(static_cast<std::map<int, int>>(a)), other{i}{{a, {{b}}}}" for i in range(60))
    src = f"""
    namespace {"a::" * 60}z {{ int deep() {{ return 0; }} }}
    class Big {{ public: Big(int a, int b) noexcept(sizeof(int) > 2) : {init} {{ run(); }} void only(int a); Big& operator=(const Big&) {{ return *this; }} }};
    Big::Big(int a) : {init} {{ other(); }}
    auto far(int a) -> std::map<int, std::vector<decltype(a)>> {{ return f(a); }}
    int declared(int a);
    int used() {{ return declared(1) ? declared(2) : declared(3); }}
    """
    _, got = X.cpp(src)
    assert got["methods"] == ["Big", "Big"] and got["functions"] == ["deep", "far", "used"] and got["classes"] == ["Big"]
    throws = ", ".join(f"some.long.name.of.an.Exception{i}" for i in range(60))
    _, got = X.java(f"class A {{ A(int a) throws {throws} {{ go(); }} void run() throws {throws} {{ stop(); }} {'public ' + ' ' * 300}int x(int a) {{ return f(a); }} }} interface I {{ int m() throws {throws}; }}")
    assert got["methods"] == ["run", "x"] and got["functions"] == ["A", "m"]


def test_time_on_damaged_code():
    import time

    began = time.perf_counter()
    for extractor in (X.javascript, X.typescript, X.cpp, X.java, X.go, X.rust, X.css, X.html):
        for piece in ("f(", "a<", "class A { m(", "{ x(): {", "const a: {", "x = /", "namespace a { ", "use "):
            extractor(piece * 4000)
    assert X.parse("deep.js", "`${" * 4000)[3]
    assert time.perf_counter() - began < 120


def test_python():
    src = '''"""Module."""
import os, numpy as np
import a.b.c
from __future__ import annotations
from .utils import helper
from . import sibling
from pkg.mod import thing
class X(Base):
    """Class."""
    @property
    def name(self): return 1
    async def method1(self):
        def inner(): pass
    if True:
        def conditional(self): pass
def method1():
    "short"
    x = "not a docstring"
'''
    deps, got = X.python(src)
    assert deps == ["os", "numpy", "a.b.c", ".utils", ".", "pkg.mod"]
    assert got["classes"] == ["X"] and got["methods"] == ["name", "method1"] and got["functions"] == ["inner", "conditional", "method1"]
    assert got["docstrings"] == ['"""Module."""', '"""Class."""', '"short"']


def test_broken_python():
    src = "import os, sys as s\nfrom .m import x\nclass A:\n    def m(self):\n        def n(): pass\n    x = (\ndef f(:\n    pass\n"
    deps, got = X.python(src)
    assert deps == ["os", "sys", ".m"] and got["classes"] == ["A"] and got["methods"] == ["m"] and got["functions"] == ["n", "f"]


def test_cpp():
    src = """
    // line
    /* block */
    #include <vector>
    #include "local.h"
    #define F(x) class Macro {}
    namespace app { class Fwd;
    template <class T> class Box : public Base { public: Box() : v(0) {} ~Box() {} int get() const { return v; } void later(); };
    enum class Color { Red };
    struct S { void in_struct() {} };
    int add(int a, int b) { if (a) { call(b); } return a + b; }
    }
    void X::method2() {}
    int main() { return app::add(1, 2); }
    """
    deps, got = X.cpp(src)
    assert deps == ["vector", "local.h"] and got["classes"] == ["Fwd", "Box"] and got["functions"] == ["app", "add", "main"]
    assert got["methods"] == ["Box", "get", "method2"] and got["docstrings"] == ["// line", "/* block */"]


def test_java():
    src = """
    package p; import java.util.List; import static a.b.C.d; import x.y.*;
    /** Doc. */
    public class Main extends B { private int n = f(1); public Main(int a) { this.n = a; } @Override public String toString() { return go("x"); }
      <T> List<T> all(T t) throws E { for (;;) { run(t); } } abstract void none(); int[] arr() { return new int[] {1}; } }
    interface Shape { double area(); default void draw() {} }
    enum Kind { A, B; void inEnum() {} }
    """
    deps, got = X.java(src)
    assert deps == ["java.util.List", "a.b.C.d", "x.y"] and got["classes"] == ["Main", "Shape"]
    assert got["methods"] == ["toString", "all", "none", "arr"] and got["functions"] == ["Main", "area", "draw", "inEnum"] and got["docstrings"] == ["/** Doc. */"]


def test_go():
    src = """package main
import "fmt"
import (
	"net/http"
	m "math"
)
type Server struct { port int }
type (
	A struct { x int }
	B interface { M() }
	C = D
)
func main() { fmt.Println("import \\"no\\"") }
func (s *Server) Start(a int) error { return nil }
func gen[T any](x T) {}
"""
    deps, got = X.go(src)
    assert deps == ["fmt", "net/http", "math"] and got["classes"] == ["Server", "A", "B"] and got["functions"] == ["main", "gen"] and got["methods"] == ["Start"]


def test_rust():
    src = """use std::collections::HashMap;
use crate::{a, b::c};
extern crate serde;
pub struct Point { x: i32 }
enum Kind { A }
trait Shape { fn area(&self) -> f64; }
impl Shape for Point { fn area(&self) -> f64 { 1.0 } }
impl<T> Box<T> { }
// fn commented() {}
pub fn main() { let s = "fn string()"; let c = 'x'; let l: &'static str = ""; }
"""
    deps, got = X.rust(src)
    assert deps == ["std::collections::HashMap", "crate::{a, b::c}", "serde"]
    assert got["flat"] == ["Point", "Kind", "Shape", "area", "Point", "area", "main"] or got["flat"] == ["Point", "Kind", "Shape", "Point", "area", "main"]
    _, got = X.rust(src, structured=True)
    assert got["classes"] == ["Point", "Kind", "Shape"] and "main" in got["functions"]


def test_css():
    src = '@import "base.css" ; @import url( "base.css" ); @import url(\'u.css\'); .bg { background: url(bg.png) no-repeat; } .q { src: url("q.woff"), url(z.woff); } /* url(no.png) */'
    assert X.css(src)[0] == ["base.css", "u.css", "q.woff", "bg.png", "z.woff"]


def test_html():
    src = '<script src="app.js"></script><link rel="stylesheet" href="style.css"><img src=\'logo.png\' alt="x > y"><img src=bare.png><!-- <img src="no.png"> --><a href="not.html">x</a><script>var a = \'<img src="in.js">\';</script>'
    assert X.html(src)[0] == ["style.css", "logo.png", "app.js"]
    assert X.html(src, (("a", "href"),))[0] == ["not.html", "app.js"]


@pytest.mark.parametrize(("path", "source"), [("/a.js", ""), ("/a.js", "  \n\u3000"), ("/a.xyz", "x"), ("/a.js", None), ("/.js", "x")])
def test_no_record(path, source):
    assert X.parse(path, source) == (path, [], X._entities(), True)


def test_long_source_is_quick():
    X.parse("/a.js", "const a = [" + "1," * 200000 + "];")


def test_parse_files(spark):
    files = spark.createDataFrame([("/b.js", 0, b"import 'x'"), ("/a.py", 1, b"import y"), ("/c.js", 2, None), ("/d.css", 3, b"\xff\xfe")], "path string, ord long, content binary")
    got = X.parse_files(files).orderBy("ord").collect()
    assert [(r.id, r.dependencies, r.error) for r in got] == [("/b.js", ["x"], False), ("/a.py", ["y"], False), ("/c.js", [], True), ("/d.css", [], False)]


def test_parsing_tells_how_far_it_is(spark):
    files = spark.createDataFrame([(f"/f{i}.py", i, bytearray(b"import a") if i % 5 else bytearray(b" ")) for i in range(60)], "path string, ord long, content binary")
    heard = []
    got = X.parse_now(files, heard.append, tasks=3, every=0.01)
    assert got.count() == 60 == heard[-1] and heard == sorted(heard) and got.where("error").count() == 12
    assert X.parse_files(files, tasks=3).rdd.getNumPartitions() == 3
