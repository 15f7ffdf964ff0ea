"""Chat formatting: the cheapest repair of each conversation's roles, and its rendering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cols, fresh, load

#: What an edit of a turn costs.
MERGE, RELABEL, INSERT = 1, 2, 3
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
#: The legal turns: role -> roles that may follow. A conversation begins as
#: after BEGIN and ends after an assistant's turn.
BEGIN = ""
FOLLOWS = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ROLES = (SYSTEM, USER, ASSISTANT)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What a marker inside a text becomes, so that a text can't forge a turn.
GUARD = "<\\|im_"

KEEP, JOIN, NAME, FILL = "keep", "merge", "relabel", "insert"


def _bridges() -> dict[tuple[str, str], tuple[str, ...]]:
    """The fewest empty turns that lead from one role to a turn of another."""
    out = {}
    for begin in FOLLOWS:
        queue: list[tuple[str, tuple[str, ...]]] = [(begin, ())]
        seen = set()
        while queue:
            at, path = queue.pop(0)
            for role in FOLLOWS[at]:
                out.setdefault((begin, role), path)
                if role not in seen:
                    seen.add(role)
                    queue.append((role, (*path, role)))
    return out


BRIDGES = _bridges()


@lru_cache(maxsize=1 << 16)
def repair(roles: tuple[str | None, ...]) -> tuple[int, tuple[tuple[str, str, int], ...]]:
    """(cost, edits) of the cheapest way to legal turns.

    An edit is (what, role, turn): ``keep`` and ``relabel`` open a turn of
    the role, ``merge`` adds a turn to the one before, whatever its role was
    (which it keeps if equal, and else is relabelled to), and ``insert``
    opens an empty one (turn -1). Dynamic programming over the role of the
    last open turn; of equal costs, the way with fewer inserts, then fewer
    relabels, then fewer merges, and then the earlier role in ROLES.
    """
    state: dict[str, tuple[tuple[int, int, int, int], tuple | None]] = {BEGIN: ((0, 0, 0, 0), None)}
    for t, role in enumerate(roles):
        ahead: dict[str, tuple[tuple[int, int, int, int], tuple | None]] = {}
        for last, (cost, path) in state.items():
            for to in ROLES:
                wrong = role != to
                if last == to:
                    step = (MERGE + RELABEL * wrong, 0, int(wrong), 1)
                    _take(ahead, to, cost, step, path, [(JOIN, to, t)])
                if (last, to) in BRIDGES:
                    bridge = BRIDGES[last, to]
                    step = (INSERT * len(bridge) + RELABEL * wrong, len(bridge), int(wrong), 0)
                    _take(ahead, to, cost, step, path, [*((FILL, b, -1) for b in bridge), (NAME if wrong else KEEP, to, t)])
        state = ahead
    best = None
    for last in (BEGIN, *ROLES):
        if last in state:
            cost, path = state[last]
            tail = () if last in (BEGIN, ASSISTANT) else (*BRIDGES[last, ASSISTANT], ASSISTANT)
            whole = tuple(a + b for a, b in zip(cost, (INSERT * len(tail), len(tail), 0, 0)))
            if best is None or whole < best[0]:
                best = (whole, path, tail)
    cost, path, tail = best
    edits = [(FILL, r, -1) for r in reversed(tail)]
    while path is not None:
        path, steps = path
        edits.extend(reversed(steps))
    return cost[0], tuple(reversed(edits))


def _take(ahead: dict, to: str, cost: tuple, step: tuple, path, edits: list) -> None:
    whole = tuple(a + b for a, b in zip(cost, step))
    if to not in ahead or whole < ahead[to][0]:
        ahead[to] = (whole, (path, edits))


def render(edits: Sequence[tuple[str, str, int]], texts: Sequence[str | None]) -> tuple[str, int]:
    """(the turns with their markers, how many there are)."""
    turns: list[tuple[str, list[str]]] = []
    for what, role, t in edits:
        if what == JOIN:
            turns[-1][1].append(texts[t] or "")
        else:
            turns.append((role, [] if t < 0 else [texts[t] or ""]))
    safe = [(role, "\n".join(p for p in parts if p).replace("<|im_", GUARD)) for role, parts in turns]
    return "".join(f"{OPEN}{role}\n{text}{CLOSE}\n" for role, text in safe), len(turns)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, cost, n_turns, n_edits, edits, rendered): each conversation repaired and rendered.

    Legal are an optional system turn, then turns of user and assistant
    alternately, an assistant's the last. Turns in order of ``turn`` are
    kept, merged into the turn before (1), relabelled (2), or preceded by
    empty turns (3 each); :func:`repair` finds the least total.

    Defined results: roles are trimmed and lower-cased, and any but the
    three, null included, must be relabelled; null texts are empty, and empty
    parts leave no line in a merged turn; turns without a number come last,
    ties go by role and text, repeated rows stand twice; a row with a null
    ``conv_id`` belongs to none that is known and is a conversation of its
    own, with a null id; markers inside texts are broken up; other columns
    don't matter. An empty table gives an empty one. A conversation must fit
    in a task's memory.
    """
    held = fresh(turns, "held")[0]
    kind = turns.schema["conv_id"].dataType.simpleString()
    row = F.struct(
        col("turn").isNull().alias("late"),
        col("turn").alias("turn"),
        F.lower(F.trim(col("role").cast("string"))).alias("role"),
        col("text").cast("string").alias("text"),
    )
    known = col("conv_id").isNotNull()
    talks = turns.where(known).groupBy(col("conv_id").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias(held))
    talks = talks.unionByName(turns.where(~known).select(col("conv_id").alias("conv_id"), F.array(row).alias(held)))
    slim = talks.select("conv_id", F.col(f"{held}.role").alias("roles"), F.col(f"{held}.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                few = batch.slice(at, 1024)
                out = []
                for roles, texts in zip(few.column(1).to_pylist(), few.column(2).to_pylist()):
                    cost, edits = repair(tuple(roles)) if len(roles) <= 4096 else repair.__wrapped__(tuple(roles))
                    text, n = render(edits, texts)
                    out.append((cost, n, sum(e[0] != KEEP for e in edits), " ".join(f"{what}:{role}" for what, role, _ in edits), text))
                columns = zip(*out)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([few.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["conv_id", "cost", "n_turns", "n_edits", "edits", "rendered"])

    return slim.mapInArrow(run, f"conv_id {kind}, cost long, n_turns long, n_edits long, edits string, rendered string")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(load(spark, sf_dir, "conversations"))


#: The same by a recursion over turns: a row for each conversation, turn and role of the last open turn.
#: ``seq`` is the order in which equal ways are met.
CHAT_SQL = """
WITH RECURSIVE sorted AS (
  SELECT coalesce('c' || conv_id, 'r' || row_number() OVER ()) AS key, conv_id, turn, lower(trim(role)) AS role, coalesce(text, '') AS text, text AS raw FROM {turns}
), turns AS (
  SELECT key, conv_id, role, replace(text, '<|im_', '{guard}') AS text,
    row_number() OVER (PARTITION BY key ORDER BY turn IS NULL, turn, role NULLS FIRST, raw NULLS FIRST) AS t, count(*) OVER (PARTITION BY key) AS n FROM sorted
), steps(seq, last, next, merges, fills) AS (VALUES
  (0, '', 'system', 0, []), (1, '', 'user', 0, []), (2, '', 'assistant', 0, ['user']),
  (3, 'system', 'system', 1, []), (4, 'system', 'user', 0, []), (5, 'system', 'assistant', 0, ['user']),
  (6, 'user', 'user', 1, []), (7, 'user', 'user', 0, ['assistant']), (8, 'user', 'assistant', 0, []),
  (9, 'assistant', 'user', 0, []), (10, 'assistant', 'assistant', 1, []), (11, 'assistant', 'assistant', 0, ['user'])
), ways AS (
  SELECT DISTINCT key, conv_id, n, 0::BIGINT AS t, '' AS last, 0::BIGINT AS cost, 0::BIGINT AS ins, 0::BIGINT AS rel, 0::BIGINT AS mer, 0::BIGINT AS n_turns, 0::BIGINT AS n_edits,
    []::VARCHAR[] AS edits, '' AS done, '' AS said FROM turns
  UNION ALL
  SELECT key, conv_id, n, t, last, cost, ins, rel, mer, n_turns, n_edits, edits, done, said FROM (
    SELECT w.key, w.conv_id, w.n, u.t, s.next AS last, wrong, s.seq,
      w.cost + {merge} * s.merges + {insert} * len(s.fills) + {relabel} * wrong AS cost, w.ins + len(s.fills) AS ins, w.rel + wrong AS rel, w.mer + s.merges AS mer,
      w.n_turns + 1 - s.merges + len(s.fills) AS n_turns, w.n_edits + len(s.fills) + greatest(s.merges, wrong) AS n_edits,
      w.edits || list_transform(s.fills, lambda f: 'insert:' || f) || [CASE WHEN s.merges = 1 THEN 'merge:' WHEN wrong = 1 THEN 'relabel:' ELSE 'keep:' END || s.next] AS edits,
      CASE WHEN s.merges = 1 THEN w.done ELSE w.done || CASE WHEN w.last = '' THEN '' ELSE '{open}' || w.last || chr(10) || w.said || '{close}' || chr(10) END
        || list_aggregate(list_transform(s.fills, lambda f: '{open}' || f || chr(10) || '{close}' || chr(10)) || [''], 'string_agg', '') END AS done,
      CASE WHEN s.merges = 0 OR w.said = '' THEN u.text WHEN u.text = '' THEN w.said ELSE w.said || chr(10) || u.text END AS said
    FROM ways w JOIN (SELECT * FROM turns) u ON u.key = w.key AND u.t = w.t + 1 JOIN steps s ON s.last = w.last, LATERAL (SELECT (u.role IS DISTINCT FROM s.next)::BIGINT AS wrong)
  ) QUALIFY row_number() OVER (PARTITION BY key, last ORDER BY cost, ins, rel, mer, seq) = 1
), ended AS (
  SELECT *, CASE last WHEN 'system' THEN ['user', 'assistant'] WHEN 'user' THEN ['assistant'] ELSE [] END AS tail FROM ways WHERE t = n
)
SELECT conv_id, cost + {insert} * len(tail) AS cost, n_turns + len(tail) AS n_turns, n_edits + len(tail) AS n_edits,
  array_to_string(edits || list_transform(tail, lambda f: 'insert:' || f), ' ') AS edits,
  done || '{open}' || last || chr(10) || said || '{close}' || chr(10) || list_aggregate(list_transform(tail, lambda f: '{open}' || f || chr(10) || '{close}' || chr(10)) || [''], 'string_agg', '') AS rendered
FROM ended QUALIFY row_number() OVER (PARTITION BY key ORDER BY cost + {insert} * len(tail), ins + len(tail), rel, mer, last = 'assistant', last = 'user') = 1
"""

QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {"op2_chat_format": CHAT_SQL.format(turns="conversations", guard=GUARD, open=OPEN, close=CLOSE, merge=MERGE, relabel=RELABEL, insert=INSERT)}
