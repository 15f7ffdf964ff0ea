"""Languages by file extension, and technology stacks by marker file."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: language -> (extensions, colour)
LANGUAGES = {
    "JavaScript": ((".js", ".jsx"), "#f1e05a"),
    "TypeScript": ((".ts", ".tsx"), "#3178c6"),
    "Python": ((".py",), "#3572A5"),
    "C++": ((".cpp", ".h", ".hpp"), "#f34b7d"),
    "HTML": ((".html",), "#e34c26"),
    "CSS": ((".css",), "#563d7c"),
    "Rust": ((".rs",), "#dea584"),
    "Go": ((".go",), "#00ADD8"),
    "Java": ((".java",), "#b07219"),
}
LANGUAGE_OF = {ext: name for name, (exts, _) in LANGUAGES.items() for ext in exts}

#: (marker file, dependency it must declare or None, stack), the first that holds decides
_NODE = ("next:nextjs", "@angular/core:angular", "react:react", "vue:vue", "svelte:svelte", "express:express", "fastify:fastify", "hono:hono")
STACKS = (
    *(("package.json", *pair.rsplit(":", 1)) for pair in _NODE),
    ("package.json", None, "node"),
    *(("requirements.txt", name, name) for name in ("django", "flask", "fastapi")),
    *((name, None, "python") for name in ("pyproject.toml", "setup.py", "requirements.txt")),
    ("CMakeLists.txt", None, "cpp"),
    ("Makefile", None, "cpp"),
    ("Cargo.toml", None, "rust"),
    ("go.mod", None, "go"),
    ("composer.json", None, "php"),
    ("Gemfile", None, "ruby"),
    *((name, None, "java") for name in ("pom.xml", "build.gradle", "build.gradle.kts")),
)


def language(ext: Column) -> Column:
    """The language of an extension, whatever its case, or ``Unknown``."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("Unknown"))


def manifest_names(text: str | None) -> set[str]:
    """Names that a package manifest declares; none if it can't be read."""
    try:
        held = json.loads(text or "")
        return {name for part in ("dependencies", "devDependencies") for name in (held.get(part) or {})}
    except (ValueError, AttributeError, TypeError):
        return set()


def requirement_names(text: str | None) -> set[str]:
    """Lower-cased names in a requirements list, without comments and versions."""
    lines = (line.strip().lower() for line in (text or "").splitlines())
    return {re.split(r"[=<>!~\[\s]", line)[0] for line in lines if line and not line.startswith("#")}


def detect_stack(markers: dict[str, str]) -> str:
    """The stack of a folder from its marker files' texts, ``node`` if none holds.

    A manifest that can't be parsed doesn't count as one.
    """
    for name, needed, stack in STACKS:
        if name not in markers:
            continue
        if name == "package.json":
            try:
                json.loads(markers[name])
            except ValueError:
                continue
            if needed is None or needed in manifest_names(markers[name]):
                return stack
        elif needed is None or needed in requirement_names(markers[name]):
            return stack
    return "node"
