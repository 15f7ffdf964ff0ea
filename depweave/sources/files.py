"""Source trees as tables of files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reach_workers
from ..functions.languages import LANGUAGE_OF, STACKS, detect_stack, manifest_names
from ..operators.storage import numbered
from ..schema import FILES

MOST_BYTES = 2 << 20


class IgnoreRules:
    """Ignore patterns, the last that fits a path deciding.

    ``!`` takes back, a leading or inner slash ties a pattern to the root, a
    trailing one to folders' contents, ``*`` and ``?`` stop at slashes and
    ``**`` doesn't.
    """

    def __init__(self, patterns: Iterable[str]):
        self.rules = [(not p.startswith("!"), self._regex(p.removeprefix("!"))) for p in patterns if p.strip() and not p.startswith("#")]

    @staticmethod
    def _regex(pattern: str) -> re.Pattern:
        inside = pattern.endswith("/")
        body = pattern.strip().rstrip("/")
        tied = "/" in body
        body = body.lstrip("/")
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            elif body[i] == "[" and "]" in body[i + 1 :]:
                end = body.index("]", i + 1)
                out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                out, i = out + re.escape(body[i]), i + 1
        return re.compile(("" if tied else "(?:.*/)?") + out + ("/.*" if inside else "(?:/.*)?") + r"\Z", re.S)

    def ignores(self, path: str) -> bool:
        out = False
        for takes, regex in self.rules:
            if regex.match(path):
                out = takes
        return out


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file, without blank lines and comments."""
    return [s for line in text.splitlines() if (s := line.strip()) and not s.startswith("#")]


def read_ignore_file(folder: str, name: str = ".agentignore") -> list[str]:
    try:
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            return ignore_lines(f.read())
    except OSError:
        return []


@dataclass
class Discovered:
    files: list[tuple[str, str, str, int, float]]  # path, relative path, extension, size, time in ms
    ignored: int


def discover(root: str, rules: IgnoreRules | None = None, most_bytes: int = MOST_BYTES) -> Discovered:
    """Source files below a folder: no links, nothing ignored (counted once at its top), too large or of an unknown extension.

    Folders and files that can't be read are passed over.
    """
    root = os.path.abspath(root)
    out = Discovered([], 0)
    todo = [root]
    while todo:
        try:
            with os.scandir(todo.pop()) as entries:
                found = sorted(entries, key=lambda e: e.name)
        except OSError:
            continue
        below = []
        for e in found:
            try:
                if e.is_symlink():
                    continue
                if rules is not None and rules.ignores(os.path.relpath(e.path, root)):
                    out.ignored += 1
                elif e.is_dir(follow_symlinks=False):
                    below.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    stat = e.stat(follow_symlinks=False)
                    ext = os.path.splitext(e.name)[1].lower()
                    if stat.st_size <= most_bytes and ext in LANGUAGE_OF:
                        out.files.append((e.path, os.path.relpath(e.path, root), ext, stat.st_size, stat.st_mtime_ns / 1e6))
            except OSError:
                continue
        todo.extend(reversed(below))
    return out


def list_files(spark: SparkSession, *roots: str, rules: IgnoreRules | None = None, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, int]:
    """(``files``, how many entries were ignored) of folders that this machine sees; a file below two of them counts once."""
    reach_workers(spark)
    seen: dict[str, tuple] = {}
    ignored = 0
    for root in roots:
        found = discover(root, rules, most_bytes)
        ignored += found.ignored
        for row in found.files:
            seen.setdefault(row[0], row)
    return spark.createDataFrame([(*row, i) for i, row in enumerate(seen.values())], FILES), ignored


def _ignored_at(path: Column, rules: IgnoreRules) -> Column:
    """The topmost part of a relative path that the rules ignore, null if none does; all in the JVM."""

    def ignored(p: Column) -> Column:
        out = F.lit(False)
        for takes, regex in rules.rules:
            out = F.when(p.rlike("(?s)^" + regex.pattern.removesuffix(r"\Z") + r"\z"), takes).otherwise(out)
        return out

    steps = F.split(path, "/")
    tops = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    return F.get(F.filter(tops, ignored), 0)


def scan_listing(spark: SparkSession, *roots: str, rules: IgnoreRules | None = None, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, ignored): source files below folders of any file system Spark lists, and (root, path) of what the rules ignore.

    Only the listing is read. Rules see paths relative to their root and
    hold for all below; an ignored folder counts once, at its top, if it
    holds a file. A file below two roots counts once. ``ord`` numbers the
    files in the order of their paths.
    """
    reach_workers(spark)
    every, ignored = None, None
    for root in roots:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path = F.regexp_replace("path", "^file:/+", "/")
        base = re.sub("^file:/+", "/", root).rstrip("/") + "/"
        listed = found.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"))
        listed = listed.withColumn("rel_path", F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.element_at(F.split("path", "/"), -1)))
        if rules is not None and rules.rules:
            listed = listed.withColumn("at", _ignored_at(F.col("rel_path"), rules))
            gone = listed.where("at is not null").select(F.lit(root).alias("root"), F.col("at").alias("path")).distinct()
            listed = listed.where("at is null").drop("at")
            ignored = gone if ignored is None else ignored.unionByName(gone)
        every = listed if every is None else every.unionByName(listed)
    ext = F.lower(F.regexp_extract("path", r"[^./][^/]*?(\.[^./]*)$", 1))
    kept = every.where(F.col("size") <= most_bytes).withColumn("ext", ext).where(F.col("ext").isin(*LANGUAGE_OF))
    files = numbered(kept.dropDuplicates(["path"]), "path", name="ord").select(*(c.split()[0] for c in FILES.split(", ")))
    return files, ignored if ignored is not None else spark.createDataFrame([], "root string, path string")


def scan_files(spark: SparkSession, *roots: str, rules: IgnoreRules | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, ord, content of the files of :func:`scan_listing`: the bytes of files that were left out aren't read."""
    files, _ = scan_listing(spark, *roots, rules=rules, most_bytes=most_bytes)
    return with_content(files)


#: Files that a task reads at once.
READERS = 8


def with_content(files: DataFrame) -> DataFrame:
    """``files`` with the bytes of each, null where they can't be read; every task reads its own, some at once.

    Paths may be of any file system that Arrow knows.
    """

    def read(path: str) -> bytes | None:
        try:
            fs, name = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{quote(path)}")
            with fs.open_input_stream(name, compression=None) as f:
                return f.read()
        except (OSError, pa.ArrowInvalid):
            return None

    def run(frames):
        with ThreadPoolExecutor(READERS) as pool:
            for frame in frames:
                for at in range(0, len(frame), 256):
                    few = frame.iloc[at : at + 256]
                    yield few.assign(content=list(pool.map(read, few.path)))

    return files.select("path", "ord").mapInPandas(run, "path string, ord long, content binary")


def stack_of(folder: str) -> str:
    """The technology stack of a folder on this machine."""
    held = {}
    for name in {name for name, _, _ in STACKS}:
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                held[name] = f.read()
        except (OSError, UnicodeDecodeError):
            continue
    return detect_stack(held)


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """(name) that a folder's package manifest declares; none if there is no good one."""
    try:
        with open(os.path.join(folder, "package.json"), encoding="utf-8") as f:
            names = manifest_names(f.read())
    except OSError:
        names = set()
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


_PLAIN_FILES = " ".join(f"*.{e}" for e in sorted("pdf csv log ini cfg toml yml yaml json md txt svg ico gif jpeg jpg png otf ttf eot woff2 woff".split()))
_SCRIPT_OUT, _PYTHON_OUT = "build/ dist/ node_modules/", "build/ dist/ *.pyc __pycache__/ .pytest_cache/ venv/"
_STACK_OUT = {
    **dict.fromkeys(("angular", "react", "vue", "svelte", "express", "fastify", "hono"), _SCRIPT_OUT),
    **dict.fromkeys(("node", "nextjs"), _SCRIPT_OUT + " .next/"),
    **dict.fromkeys(("python", "django", "flask", "fastapi"), _PYTHON_OUT),
    "cpp": "build/ cmake-build-*/ .vscode/", "rust": "target/", "go": "", "php": "vendor/", "ruby": "vendor/bundle/", "java": "build/ .gradle/",
}


def write_ignore_file(folder: str, name: str = ".agentignore", out: str = "graph-out") -> str | None:
    """A first ignore file for the folder's stack, and that stack; None, and nothing written, if there is one."""
    stack = stack_of(folder)
    parts = {
        "Files without code": _PLAIN_FILES,
        "Settings and plans": f".agents/ .opencode/ {name}",
        "Versions": ".git/",
        "Output": f"{out}/",
        "Environment": ".env .env.local .env.*.local",
        f"Of a project in {stack}": " ".join(p if p.endswith("/") else p + "/" for p in _STACK_OUT.get(stack, "").split()),
        "Own patterns": "",
    }
    try:
        with open(os.path.join(folder, name), "x", encoding="utf-8") as f:
            f.write("\n".join(line for title, patterns in parts.items() for line in (f"# {title}", *patterns.split(), "")))
    except FileExistsError:
        return None
    return stack
