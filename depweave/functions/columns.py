"""Column expressions on node ids, paths and import texts, all evaluated in the JVM."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ENTITY_KINDS


def is_entity(kind: Column) -> Column:
    return F.coalesce(kind.isin(*ENTITY_KINDS), F.lit(False))


def is_file(external: Column, kind: Column) -> Column:
    """Neither external nor an entity; a kind of another name, or none, is a file's."""
    return ~F.coalesce(external, F.lit(False)) & ~is_entity(kind)


def is_relative(dep: Column) -> Column:
    return dep.rlike(r"^\.\.?[/\\]")


def dirname(path: Column) -> Column:
    """The folder of an absolute path."""
    head = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(path.rlike(r"^/[^/]*$"), F.lit("/")).when(path.contains("/"), head).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the name on; a dot that begins the name makes none."""
    return F.regexp_extract(basename(path), r"(?s)[^.].*?(\.[^.]*)$", 1)


def resolve(folder: Column, dep: Column) -> Column:
    """``dep`` seen from ``folder``, with ``.`` and ``..`` worked out; an absolute one stands for itself."""
    whole = F.when(dep.startswith("/"), dep).otherwise(F.concat(folder, F.lit("/"), dep))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    up = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))


def entity_id(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit("::"), name)


def parent(id_: Column) -> Column:
    """What stands before the last ``::``; an id without one is its own parent."""
    rest = F.length(F.substring_index(id_, "::", -1))
    return F.when(id_.contains("::"), F.substring(id_, F.lit(1), F.length(id_) - rest - 2)).otherwise(id_)


def label(label_: Column, id_: Column) -> Column:
    """The label, or the file name where it is missing or empty."""
    return F.coalesce(F.nullif(label_, F.lit("")), basename(id_))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"]|['\"]$", "")


def relative_path(path: Column, root: str) -> Column:
    """``path`` as seen from the folder ``root``; one outside goes up by ``..``, one that isn't absolute stays."""
    base = [s for s in root.split("/") if s]
    if not base:  # the same without lists, which are slow
        return F.when(path.startswith("/"), F.regexp_replace(F.btrim(path, F.lit("/")), "/+", "/")).otherwise(path)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    shared = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, len(base)))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.size(steps) >= i) & (F.get(steps, i - 1) == F.get(F.array(*map(F.lit, base or [""])), i - 1)), i).otherwise(acc),
    )
    up = F.array_repeat(F.lit(".."), (F.lit(len(base)) - shared).cast("int"))
    rest = F.slice(steps, (shared + 1).cast("int"), F.greatest(F.size(steps) - shared, F.lit(0)).cast("int"))
    return F.when(path.startswith("/"), F.array_join(F.concat(up, rest), "/")).otherwise(path)


def rotation(nodes: Column) -> Column:
    """A cycle's nodes from the least on, as one text; equal for all its rotations."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    turned = F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))
    return F.array_join(turned, "|")


def display(id_: Column, label_: Column, kind: Column, external: Column, folder: str = "/") -> Column:
    """(color, text) of a node in a list: externals by id, classes, functions and entities by label, the rest by path."""
    named = F.coalesce(F.nullif(label_, F.lit("")), id_)
    near = relative_path(id_, folder)
    show = lambda color, text: F.struct(F.lit(color).alias("color"), text.alias("text"))
    return (
        F.when(F.coalesce(external, F.lit(False)), show("yellow", id_))
        .when(kind == "class", show("green", named))
        .when(kind.isin("function", "entity"), show("magenta", named))
        .otherwise(show("cyan", F.coalesce(F.nullif(near, F.lit("")), id_)))
    )


def newer(a: Column, b: Column) -> Column:
    """Whether version ``a`` is above ``b`` by its first three numbers; a part that isn't a number decides nothing."""
    out = F.lit(False)
    for i in (3, 2, 1):
        x, y = (F.split_part(v, F.lit("."), F.lit(i)).try_cast("double") for v in (a, b))
        out = F.when(x > y, True).when(x < y, False).otherwise(out)
    return out


def common_root(paths: DataFrame, path: str = "path") -> str:
    """The longest folder that holds all files, ``/`` if there is no other and '' without files.

    It is what the least and the greatest list of steps have in common.
    """
    steps = F.split(dirname(F.col(path)), "/")
    row = paths.agg(F.min(steps).alias("low"), F.max(steps).alias("high")).first()
    if row is None or row.low is None:
        return ""
    shared = []
    for a, b in zip(row.low, row.high):
        if a != b:
            break
        shared.append(a)
    return "/".join(shared) or "/"


def fixed(value: float, digits: int) -> float:
    """A number rounded to so many digits from its exact binary value, halves away from zero."""
    return float(Decimal(float(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
