"""Schemas of the tables that make up a dependency graph."""

from __future__ import annotations

ENTITIES = "struct<classes: array<string>, functions: array<string>, methods: array<string>, docstrings: array<string>, flat: array<string>>"
FILES = "path string, rel_path string, ext string, size long, mtime_ms double, ord long"
PARSED = f"id string, dependencies array<string>, entities {ENTITIES}, error boolean, ord long"
NODES = (
    "id string, ord long, label string, kind string, external boolean, npm boolean, dependencies array<string>, docstrings array<string>, "
    "language string, community string, color string, size double, x double, y double, semantic_summary string"
)
EDGES = "ord long, src string, dst string, relation string, relationship string"
CYCLES = "id int, size int, files array<struct<id: string, label: string>>, edges array<struct<`from`: string, `to`: string>>, label string"
CACHE = f"path string, mtime_ms double, size long, data struct<id: string, dependencies: array<string>, entities: {ENTITIES}, error: boolean>"

ENTITY_KINDS = ("entity", "class", "function", "method")
