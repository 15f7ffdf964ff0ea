"""Imports and named entities of source files.

Sources are blanked first: comments and the insides of strings become
spaces, so that patterns see code alone and places stay comparable. Python
goes through the standard parser where it can. Damaged code never fails: it
gives what still can be seen.
"""

from __future__ import annotations

import ast
import re
import threading
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PARSED
from .storage import stored

Found = tuple[list[str], dict[str, list[str]]]


def _entities(classes=(), functions=(), methods=(), docstrings=(), flat=()) -> dict[str, list[str]]:
    return {"classes": list(classes), "functions": list(functions), "methods": list(methods), "docstrings": list(docstrings), "flat": list(flat)}


@dataclass
class Blanked:
    code: str
    comments: list[str] = field(default_factory=list)
    strings: dict[int, str] = field(default_factory=dict)  # by the place of the opening quote

    def string(self, at: int) -> str | None:
        return self.strings.get(at)


_SLASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r""""(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?"""
_C_LIKE = re.compile(f"{_SLASH}|{_QUOTED}", re.S)
_GO_LIKE = re.compile(f"{_SLASH}|`[^`]*`?|{_QUOTED}", re.S)
_RUST_LIKE = re.compile(_SLASH + r"""|r(#*)".*?"\1|"(?:\\.|[^"\\])*"?|'(?:\\.[^'\n]*|[^'\\\n])'""", re.S)
_HASH = re.compile(r"#[^\n]*|(?:[rbuf]{0,2})(\"\"\"|''').*?(?:\1|\Z)|" + _QUOTED, re.S | re.I)
_JS_START = re.compile(r"//|/\*|[\"'`/]")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw))\s*$")


def _hide(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def blank(source: str, pattern: re.Pattern) -> Blanked:
    out = Blanked("")
    parts, at = [], 0
    for m in pattern.finditer(source):
        text = m.group()
        parts.append(source[at : m.start()])
        if text.startswith(("//", "/*", "#")):
            out.comments.append(text)
            parts.append(_hide(text))
        else:
            inner = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
            out.strings[m.start()] = inner
            parts.append(text[0] + _hide(text[1:-1]) + (text[-1] if len(text) > 1 else ""))
        at = m.end()
    parts.append(source[at:])
    out.code = "".join(parts)
    return out


def blank_script(source: str) -> Blanked:
    """As :func:`blank`, for sources in which a slash may begin a pattern and back quotes may hold code."""
    out = Blanked("")
    code = list(source)

    def hide(a: int, b: int) -> None:
        for i in range(a, min(b, len(code))):
            if code[i] != "\n":
                code[i] = " "

    def template(at: int) -> int:
        """The place behind a template that begins at ``at``; code inside it stays visible."""
        i = at + 1
        while i < len(source):
            if source[i] == "\\":
                hide(i, i + 2)
                i += 2
            elif source[i] == "`":
                return i + 1
            elif source.startswith("${", i):
                i = scan(i + 2, "}")
            else:
                hide(i, i + 1)
                i += 1
        return i

    def scan(at: int, until: str) -> int:
        depth = 0
        i = at
        while i < len(source):
            c = source[i]
            if until and c == "{":
                depth += 1
            elif until and c == until:
                if not depth:
                    return i + 1
                depth -= 1
            m = _JS_START.match(source, i)
            if not m:
                i += 1
                continue
            if c == "/" and source.startswith(("//", "/*"), i):
                end = re.compile(_SLASH, re.S).match(source, i).end()
                out.comments.append(source[i:end])
                hide(i, end)
                i = end
            elif c in "'\"":
                end = re.compile(_QUOTED, re.S).match(source, i).end()
                closed = end - i > 1 and source[end - 1] == c
                out.strings[i] = source[i + 1 : end - closed]
                hide(i + 1, end - closed)
                i = end
            elif c == "`":
                i = template(i)
            elif (r := _REGEX.match(source, i)) and _BEFORE_REGEX.search(tail(code, i, 2)):
                hide(i, r.end())
                i = r.end()
            else:
                i += 1
        return i

    scan(0, "")
    out.code = "".join(code)
    return out


@lru_cache(maxsize=6)
def _closes(code: str, pair: str) -> dict[int, int]:
    out, stack = {}, []
    for m in re.finditer(f"[{re.escape(pair)}]", code):
        if m.group() == pair[0]:
            stack.append(m.start())
        elif stack and not (pair == "<>" and code[m.start() - 1] in "=-"):
            out[stack.pop()] = m.start()
    return out


def closing(code: str, at: int, pair: str = "()") -> int:
    """The place of the bracket that closes the one at ``at``, or the end. Arrows (``=>``, ``->``) close nothing."""
    return _closes(code, pair).get(at, len(code))


def _word(c: str) -> bool:
    return c.isalnum() or c in "_$"


def tail(code, at: int, n: int = 5) -> str:
    """The last ``n`` words and signs before a place, with a line end or a space for the white space between."""
    parts: list[str] = []
    while at > 0 and n:
        b = at - 1
        if code[b].isspace():
            while b > 0 and code[b - 1].isspace():
                b -= 1
            parts.append("\n" if "\n" in code[b:at] else " ")
        else:
            if _word(code[b]):
                while b > 0 and _word(code[b - 1]):
                    b -= 1
            parts.append("".join(code[b:at]))
            n -= 1
        at = b
    return "".join(reversed(parts))


_SPACES = re.compile(r"\s*")


def _skip(code: str, at: int) -> int:
    return _SPACES.match(code, at).end()


class Scopes:
    """What each brace of a source belongs to."""

    def __init__(self, code: str):
        self.starts: list[int] = []
        self.owners: list[int] = []  # the open brace directly around, from a place on; -1 outside
        stack = [-1]
        for m in re.finditer(r"[{}]", code):
            if m.group() == "{":
                stack.append(m.start())
            elif len(stack) > 1:
                stack.pop()
            self.starts.append(m.start())
            self.owners.append(stack[-1])

    def around(self, at: int) -> int:
        i = bisect_right(self.starts, at - 1) - 1
        return self.owners[i] if i >= 0 else -1


# scripts

_NAME = r"[A-Za-z_$][\w$]*"
_IMPORTS = re.compile(r"(?<![\w$.])import\b(?:\s*\(\s*|(?:[^;'\"()]*?\bfrom)?\s*)(?=['\"])|(?<![\w$.])require\s*\(\s*(?=['\"])")
_EXPRESSION = re.compile(r"(?:[=(,:?\[&|!+]|\b(?:return|new|typeof|await|yield|throw|case))\s*(?:async\s*)?$")
_FUNCTION = re.compile(rf"(?<![\w$.])function\s+({_NAME})\s*[<(]")
_CLASS = re.compile(rf"(?<![\w$.])class\s+({_NAME})")
_VALUE = re.compile(rf"\b(const|let|var)\s+({_NAME})\s*(?=[:=])")
_VALUE_OF = re.compile(rf"\s*=(?![=>])\s*(?:async\b\s*)?(function\b(?!\s*\*)|\(|<|{_NAME}\s*=>)")
_MEMBER = re.compile(rf"(?<![\w$.#])(#?{_NAME})\s*(?=[(<])")
_NOT_MEMBER = {"if", "for", "while", "switch", "catch", "function", "return", "with", "super", "await", "typeof", "import", "new"}


_BRACKETS = {"(": "()", "[": "[]", "<": "<>", "{": "{}"}


def _leads_to(code: str, at: int, wanted: str) -> bool:
    """Whether ``wanted`` (an arrow or an open brace) follows, at once or after the type that a colon begins.

    Brackets of the type are stepped over whole; a brace where a type is
    due is one of its own.
    """
    at = _skip(code, at)
    if code.startswith(wanted, at):
        return True
    if not code.startswith(":", at):
        return False
    at, due = _skip(code, at + 1), True
    while at < len(code):
        c = code[at]
        if code.startswith("=>", at):
            if wanted == "=>":
                return True
            at, due = _skip(code, at + 2), True
        elif c == "{" and not due:
            return wanted == "{"
        elif c in _BRACKETS:
            at, due = _skip(code, closing(code, at, _BRACKETS[c]) + 1), False
        elif c in ";,)}]=":
            return False
        elif _word(c):
            end = at
            while end < len(code) and (_word(code[end]) or code[end] == "."):
                end += 1
            due = code[at:end] in ("keyof", "typeof", "readonly", "is", "asserts", "extends", "infer", "unique", "new")
            at = _skip(code, end)
        else:
            at, due = _skip(code, at + 1), c in "|&?:"
    return False


def _end_of_type(code: str, at: int) -> int:
    """Where the type that a colon begins ends: at the next equals sign outside of brackets, or what can't be in one."""
    if not code.startswith(":", at):
        return at
    at += 1
    while at < len(code) and code[at] not in ";,)}]":
        if code[at] == "=":
            if not code.startswith("=>", at):
                return at
            at += 2
        else:
            at = closing(code, at, _BRACKETS[code[at]]) + 1 if code[at] in _BRACKETS else at + 1
    return at


def _script(source: str, typed: bool) -> Found:
    held = blank_script(source)
    code = held.code
    deps = [s for m in _IMPORTS.finditer(code) if (s := held.string(m.end()))]
    declared = lambda m: not _EXPRESSION.search(tail(code, m.start(), 3))
    classes = [m.group(1) for m in _CLASS.finditer(code) if declared(m) and not (typed and re.search(r"\babstract\s+$", tail(code, m.start(), 1)))]
    functions = [(m.start(1), m.group(1)) for m in _FUNCTION.finditer(code) if declared(m)]
    for m in _VALUE.finditer(code):
        if m.group(1) == "var" and not typed:
            continue
        value = _VALUE_OF.match(code, _end_of_type(code, m.end()))
        if not value:
            continue
        how = value.group(1)
        if how in ("(", "<"):
            at = value.start(1)
            if how == "<":
                at = _skip(code, closing(code, at, "<>") + 1)
                if not code.startswith("(", at):
                    continue
            if not _leads_to(code, closing(code, at) + 1, "=>"):
                continue
        functions.append((m.start(2), m.group(2)))
    methods = []
    for m in _MEMBER.finditer(code):
        name = m.group(1)
        if name in _NOT_MEMBER or (typed and name.startswith("#")):
            continue
        before = tail(code, m.start(), 3)
        if re.search(r"\b(?:function|new)\s*\*?\s*$", before) or not re.search(r"(?:[{};,*]|\*/|\b(?:static|async|get|set|public|private|protected|override|readonly)|\n)\s*$|^\s*$", before):
            continue
        at = m.end()
        if code[at] == "<":
            at = _skip(code, closing(code, at, "<>") + 1)
        if code.startswith("(", at) and _leads_to(code, closing(code, at) + 1, "{"):
            methods.append(name)
    docs = [c for c in held.comments if c.startswith("/**")]
    return deps, _entities(classes, [n for _, n in sorted(functions)], methods, docs)


def javascript(source: str) -> Found:
    return _script(source, False)


def typescript(source: str) -> Found:
    return _script(source, True)


# Python


def python(source: str) -> Found:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(source)
    deps, classes, functions, methods, docs = [], [], [], [], []
    todo: list[tuple[ast.AST, bool]] = [(tree, False)]
    while todo:
        node, in_class = todo.pop()
        match node:
            case ast.Import():
                deps.extend(a.name for a in node.names)
            case ast.ImportFrom() if node.module != "__future__":
                deps.append("." * node.level + (node.module or ""))
            case ast.ClassDef():
                classes.append(node.name)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                (methods if in_class else functions).append(node.name)
            case ast.Expr(value=ast.Constant(value=str() | bytes())) | ast.Expr(value=ast.JoinedStr()):
                docs.append(ast.get_source_segment(source, node.value) or "")
        body = set(map(id, node.body)) if isinstance(node, ast.ClassDef) else ()
        todo.extend((child, id(child) in body) for child in reversed(list(ast.iter_child_nodes(node))))
    return deps, _entities(classes, functions, methods, docs)


def _python_lines(source: str) -> Found:
    """Line by line, for sources that don't parse: an indented function directly below a class is a method."""
    held = blank(source, _HASH)
    deps, classes, functions, methods = [], [], [], []
    open_: list[tuple[int, str]] = []
    for line in held.code.splitlines():
        m = re.match(r"(\s*)(?:async\s+)?(import|from|class|def)\s+([\w.]+)(.*)", line)
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        if not m:
            continue
        _, word, name, rest = m.groups()
        if word == "import":
            deps.extend(re.findall(r"(?:^|,)\s*([\w.]+)", name + rest))
        elif word == "from" and name != "__future__" and re.match(r"\s*import\b", rest):
            deps.append(name)
        elif word == "class":
            classes.append(name)
            open_.append((depth, "class"))
        elif word == "def":
            (methods if open_ and open_[-1][1] == "class" else functions).append(name)
            open_.append((depth, "def"))
    docs = [source[at : at + len(s) + 2] for at, s in held.strings.items() if not source[source.rfind("\n", 0, at) + 1 : at].strip()]
    return deps, _entities(classes, functions, methods, docs)


# C++

_C_NOT = {"if", "for", "while", "switch", "catch", "return", "sizeof", "decltype", "alignof", "noexcept", "static_assert", "new", "delete", "throw", "requires"}
_C_CALL = re.compile(r"(?<![\w~.>])((?:[A-Za-z_]\w*(?:<[^<>;{}]*>)?\s*::\s*)*)([A-Za-z_]\w*)\s*\(")
_C_RECORD = re.compile(r"(?:\s*:[^;{}()]*)?\s*\{")
_C_TAIL = re.compile(r"(?:const|override|final|volatile|mutable|try)\b|&&?")
_C_CHECKED = re.compile(r"(?:noexcept|throw|requires)\b\s*")
_C_UNTIL = re.compile(r"[^(){};<]*")


def _c_body(code: str, at: int) -> bool:
    """Whether a body follows a function's arguments: after qualifiers, a trailing type, and what members begin with."""
    while True:
        at = _skip(code, at)
        if m := _C_TAIL.match(code, at):
            at = m.end()
        elif m := _C_CHECKED.match(code, at):
            at = closing(code, m.end()) + 1 if code.startswith("(", m.end()) else m.end()
        elif code.startswith("->", at):
            at = _C_UNTIL.match(code, at).end()
            while code[at : at + 1] in ("<", "("):
                at = _C_UNTIL.match(code, closing(code, at, _BRACKETS[code[at]]) + 1).end()
        else:
            break
    if code.startswith("{", at):
        return True
    if not code.startswith(":", at) or code.startswith("::", at):
        return False
    at += 1
    while True:  # a member, and its value in brackets or braces
        at = _C_UNTIL.match(code, at).end()
        c = code[at : at + 1]
        if c == "<":
            at = closing(code, at, "<>") + 1
        elif c == "(" or c == "{" and (tail(code, at, 1).strip()[-1:].isalnum() or tail(code, at, 1).strip()[-1:] in ("_", ">")):
            at = _skip(code, closing(code, at, _BRACKETS[c]) + 1)
            at += 3 * code.startswith("...", at)
            at = _skip(code, at)
            if not code.startswith(",", at):
                return code.startswith("{", at)
            at += 1
        else:
            return False


def cpp(source: str) -> Found:
    deps = [m.group(1)[1:-1] for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*(<[^>\n]*>|\"[^\"\n]*\")", re.sub(_SLASH, lambda m: _hide(m.group()), source, flags=re.S), re.M)]
    held = blank(source, _C_LIKE)
    code = re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", lambda m: _hide(m.group()), held.code, flags=re.M)
    scopes = Scopes(code)
    classes, bodies, records = [], set(), set()
    for m in re.finditer(r"\b(class|struct|union)\s+(?:\[\[[^\]]*\]\]\s*)?([A-Za-z_]\w*)(?:\s+final)?\s*(?=(:[^;{}]*)?([{;>,)&*]|\w|$))", code):
        before = tail(code, m.start(), 1).rstrip()
        if before.endswith(("<", ",")) or re.search(r"\benum$", before):
            continue
        body = code.find("{", m.end()) if _C_RECORD.match(code, m.end()) else -1
        if m.group(1) == "class":
            classes.append(m.group(2))
            bodies.add(body)
        else:
            records.add(body)
    bodies.discard(-1)
    records.discard(-1)
    functions = [(m.start(1), m.group(1)) for m in re.finditer(r"\bnamespace\s+([A-Za-z_]\w*)\s*\{", code)]
    spaces = {m.end() - 1 for m in re.finditer(r"\bnamespace\b[\w\s:]*\{|\bextern\s*\"[^\"]*\"\s*\{", code)}
    methods = []
    for m in _C_CALL.finditer(code):
        name = m.group(2)
        if name in _C_NOT or re.search(r"\boperator\s*$|[.>~,]\s*$|(?<!:)(?<!public)(?<!private)(?<!protected):\s*$", tail(code, m.start(), 3)):
            continue
        around = scopes.around(m.start())
        if not _c_body(code, closing(code, m.end() - 1) + 1):
            continue
        if m.group(1).strip():
            methods.append(name)
        elif around in bodies:
            methods.append(name)
        elif around not in records and (around < 0 or around in spaces):
            functions.append((m.start(2), name))
    docs = list(held.comments)
    return deps, _entities(classes, [n for _, n in sorted(functions)], methods, docs)


# Java

_JAVA_NOT = {"if", "for", "while", "switch", "catch", "return", "new", "super", "this", "synchronized", "try", "throw", "assert"}


_JAVA_BODY = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s[^;{}]*|default\s[^;{}]*)?[{;]")


def java(source: str) -> Found:
    held = blank(source, _C_LIKE)
    code = held.code
    deps = [re.sub(r"\s", "", m.group(1)) for m in re.finditer(r"\bimport\s+(?:static\s+)?([\w$]+(?:\s*\.\s*[\w$]+)*)\s*(?:\.\s*\*)?\s*;", code)]
    scopes = Scopes(code)
    classes, kind, owner = [], {}, {}
    for m in re.finditer(r"(?<![\w$.@])(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)", code):
        body = code.find("{", m.end())
        kind[body], owner[body] = m.group(1), m.group(2)
        if m.group(1) in ("class", "interface") and code[m.start() - 1 : m.start()] != "@":
            classes.append(m.group(2))
    for m in re.finditer(r"\bnew\s+[\w$.<>,\s]+\(", code):  # a class without a name
        end = closing(code, m.end() - 1)
        if code.startswith("{", at := _skip(code, end + 1)):
            kind[at] = "class"
    functions, methods = [], []
    for m in re.finditer(r"(?<![\w$.@])([A-Za-z_$][\w$]*)\s*\(", code):
        around = scopes.around(m.start())
        if around not in kind or m.group(1) in _JAVA_NOT or not _JAVA_BODY.match(code, closing(code, m.end() - 1) + 1):
            continue
        before = tail(code, m.start(), 4)
        typed = re.search(r"[\w$>\]]\s+$|[>\]]$", before) and not re.search(r"(?:^|[;{}])\s*(?:public|private|protected)?\s*$|\b(?:public|private|protected)\s+$", before)
        if re.search(r"\b(?:new|return|=)\s*$|=\s*$", before):
            continue
        if typed and kind[around] == "class":
            methods.append(m.group(1))
        elif typed or m.group(1) == owner.get(around):
            functions.append(m.group(1))
    return deps, _entities(classes, functions, methods, [c for c in held.comments if c.startswith("/**")])


# Go


def go(source: str) -> Found:
    held = blank(source, _GO_LIKE)
    code = held.code
    deps = []
    for m in re.finditer(r"^[ \t]*import\s*(?:(\()|(?:[\w.]+[ \t]+)?(?=\"))", code, re.M):
        end = closing(code, m.end() - 1) if m.group(1) else m.end() + 1
        deps.extend(s for at, s in held.strings.items() if m.end() <= at < end and code[at] == '"')
    classes = []
    for m in re.finditer(r"^[ \t]*type\s+(?:(\()|([A-Za-z_]\w*))", code, re.M):
        if not m.group(1):
            if not code.startswith("=", _skip(code, m.end())):
                classes.append(m.group(2))
            continue
        depth = 0
        for line in code[m.end() : closing(code, m.end() - 1)].split("\n"):
            if not depth and (n := re.match(r"\s*([A-Za-z_]\w*)(?!\s*=)\b", line)):
                classes.append(n.group(1))
            depth += len(re.findall(r"[{(]", line)) - len(re.findall(r"[})]", line))
    functions = [m.group(1) for m in re.finditer(r"^[ \t]*func\s+([A-Za-z_]\w*)\s*[\[(]", code, re.M)]
    methods = [m.group(1) for m in re.finditer(r"^[ \t]*func\s*\([^)]*\)\s*([A-Za-z_]\w*)\s*\(", code, re.M)]
    return deps, _entities(classes, functions, methods)


# Rust


_RUST_UNTIL = re.compile(r"[^({;<\[]*")


def _rust_body(code: str, at: int) -> bool:
    """Whether a function's head ends in a body, and not in a semicolon as a trait's promise does."""
    while True:
        at = _RUST_UNTIL.match(code, at).end()
        c = code[at : at + 1]
        if c not in ("(", "<", "["):
            return c == "{"
        at = closing(code, at, _BRACKETS[c]) + 1


def rust(source: str, structured: bool = False) -> Found:
    """Entities are one list in the order of the source unless ``structured``."""
    code = blank(source, _RUST_LIKE).code
    found = [(m.start(), re.sub(r"\s+$", "", m.group(1))) for m in re.finditer(r"(?<![\w$])use\s+([^;]+);", code)]
    found += [(m.start(), m.group(1)) for m in re.finditer(r"\bextern\s+crate\s+(\w+)", code)]
    deps = [d for _, d in sorted(found)]
    things = [(m.start(), m.group(1), m.group(2)) for m in re.finditer(r"(?<!\w)(struct|enum|trait|fn)\s+([A-Za-z_]\w*)", code) if m.group(1) != "fn" or _rust_body(code, m.end())]
    for m in re.finditer(r"(?<!\w)impl\b(?:\s*<[^{]*?>)?\s+(?:[^{;]*?\bfor\s+)?([A-Za-z_]\w*)\s*(?:where\b[^{]*)?\{", code):
        things.append((m.start(1), "impl", m.group(1)))
    things.sort()
    if not structured:
        return deps, _entities(flat=[name for _, _, name in things])
    return deps, _entities([n for _, k, n in things if k in ("struct", "enum", "trait")], [n for _, k, n in things if k == "fn"])


# styles and pages


def css(source: str) -> Found:
    code = re.sub(r"/\*.*?(?:\*/|\Z)", lambda m: _hide(m.group()), source, flags=re.S)
    bare = lambda s: re.sub(r"^['\"]|['\"]$", "", s)
    quoted = r"(\"[^\"\n]*\"|'[^'\n]*')"
    groups = (
        re.findall(rf"@import\s+{quoted}", code),
        re.findall(rf"@import\s+url\(\s*{quoted}\s*\)", code),
        [q for d in re.findall(r"[\w-]+\s*:((?:[^;{}(]|\([^)]*\))*)", code) for q in re.findall(rf"url\(\s*{quoted}\s*\)", d)],
        [q for d in re.findall(r"[\w-]+\s*:((?:[^;{}(]|\([^)]*\))*)", code) for q in re.findall(r"url\(\s*([^\s'\"()]+)\s*\)", d)],
    )
    return list(dict.fromkeys(bare(s) for g in groups for s in g)), _entities()


_TAG = re.compile(r"<(link|img|script|a)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def html(source: str, wanted: tuple[tuple[str, str], ...] = (("link", "src"), ("link", "href"), ("img", "src"), ("img", "href"))) -> Found:
    """Quoted sources and links of ``wanted`` (tag, attribute), then the sources of scripts."""
    code = re.sub(r"<!--.*?(?:-->|\Z)", lambda m: _hide(m.group()), source, flags=re.S)
    code = re.sub(r"(<script\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)(.*?)(?=</script|\Z)", lambda m: m.group(1) + _hide(m.group(2)), code, flags=re.S)
    first, scripts = [], []
    for tag, attributes in _TAG.findall(code):
        for name, double, single in _ATTRIBUTE.findall(attributes):
            value = double or single
            if value and tag == "script" and name == "src":
                scripts.append(value)
            elif value and (tag, name) in wanted:
                first.append(value)
    return first + scripts, _entities()


EXTRACTORS: dict[str, Callable[[str], Found]] = {
    ".js": javascript, ".jsx": javascript, ".ts": typescript, ".tsx": typescript, ".py": python, ".cpp": cpp, ".h": cpp, ".hpp": cpp,
    ".html": html, ".css": css, ".rs": rust, ".go": go, ".java": java,
}


def parse(path: str, source: str | None) -> tuple[str, list[str], dict[str, list[str]], bool]:
    """(id, dependencies, entities, error): a blank or unreadable source or an unknown extension is an error."""
    dot = re.search(r"[^./][^/]*?(\.[^./]*)$", path)
    extractor = EXTRACTORS.get(dot.group(1).lower()) if dot else None
    if extractor is None or source is None or not source.strip():
        return path, [], _entities(), True
    try:
        deps, found = extractor(source)
    except Exception:  # noqa: BLE001  one file's fault is a record, not the end of the job
        return path, [], _entities(), True
    return path, deps, found, False


def parse_files(files: DataFrame, tasks: int | None = None, done: Accumulator | None = None) -> DataFrame:
    """Parsed records of ``files`` (path, ord, content binary), failures as records.

    ``tasks`` spreads the files over so many tasks, whatever their folders
    are; read contents behind it, so that they needn't move. ``done`` counts
    the files.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [parse(p, None if c is None else bytes(c).decode("utf-8", "replace")) for p, c in zip(frame.path, frame.content)]
            out = pd.DataFrame(rows, columns=["id", "dependencies", "entities", "error"])
            out["ord"] = frame.ord.to_numpy()
            if done is not None:
                done.add(len(rows))
            yield out

    slim = files.select("path", "ord", "content")
    return (slim.repartition(tasks) if tasks else slim).mapInPandas(run, PARSED)


def parse_now(files: DataFrame, progress: Callable[[int], None], tasks: int | None = None, every: float = 0.2) -> DataFrame:
    """:func:`parse_files`, run and stored; ``progress`` hears how many files are done whenever a task ends, and the last time all of them."""
    done, over = files.sparkSession.sparkContext.accumulator(0), threading.Event()

    def tell() -> None:
        last = 0
        while not over.wait(every):
            if done.value != last:
                last = done.value
                progress(last)

    teller = threading.Thread(target=tell, daemon=True)
    teller.start()
    try:
        out = stored(parse_files(files, tasks, done))
    finally:
        over.set()
        teller.join()
    progress(out.count())  # a repeated task counts its files again
    return out


def link_targets(pages: DataFrame, tag: str = "a", attribute: str = "href") -> DataFrame:
    """(page_id, pos, dep): the quoted values of an attribute, from 0 on, without leaving the JVM."""
    pattern = rf'<{tag}\s(?:[^>"]|"[^"]*")*?{attribute}="([^"]*)"'
    found = F.regexp_extract_all("html", F.lit(pattern), 1)
    return pages.select("page_id", F.posexplode(found).alias("pos", "dep")).select("page_id", F.col("pos").cast("long").alias("pos"), "dep")
