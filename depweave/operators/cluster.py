"""Batches of files for summaries, and the calls that summarise them."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import is_file, label
from .storage import numbered, stored

BATCH = 8
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 1.0, 32.0
RATE = 30


def batches(nodes: DataFrame, size: int = BATCH) -> DataFrame:
    """(community, batch, id): files of a community in node order, ``size`` to a batch."""
    order = ("ord", "id") if "ord" in nodes.columns else ("id",)
    place = F.row_number().over(Window.partitionBy("community").orderBy(*order)) - 1
    return nodes.where(is_file(F.col("external"), F.col("kind"))).select("community", F.floor(place / size).cast("long").alias("batch"), "id")


def payloads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, ast_classes, ast_functions, ast_docstrings, graph_edges_to): what is told about each file.

    Methods are left out; functions and entities without a finer kind are
    told together; links go to nodes without any kind. Lists are in order of
    the first edge.
    """
    order = F.col("ord") if "ord" in edges.columns else F.lit(0)
    links = edges.select("src", "dst", order.cast("long").alias("o")).groupBy("src", "dst").agg(F.min("o").alias("o"))
    ends = nodes.select(F.col("id").alias("dst"), "kind", label(F.col("label"), F.col("id")).alias("name"))
    seen = links.join(ends, "dst")
    pick = lambda cond, what: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("o", F.col(what).alias("v"))))), lambda s: s["v"])
    told = seen.groupBy("src").agg(
        pick(F.col("kind") == "class", "name").alias("ast_classes"),
        pick(F.col("kind").isin("function", "entity"), "name").alias("ast_functions"),
        pick(F.coalesce(F.col("kind"), F.lit("")) == "", "dst").alias("graph_edges_to"),
    )
    docs = F.col("docstrings") if "docstrings" in nodes.columns else F.lit(None).cast("array<string>")
    none = F.array().cast("array<string>")
    files = nodes.where(is_file(F.col("external"), F.col("kind"))).select("id", F.coalesce(docs, none).alias("ast_docstrings"))
    return files.join(told, F.col("id") == F.col("src"), "left").select(
        F.col("id").alias("file"), F.coalesce("ast_classes", none).alias("ast_classes"), F.coalesce("ast_functions", none).alias("ast_functions"), "ast_docstrings", F.coalesce("graph_edges_to", none).alias("graph_edges_to")
    )


def payload_sizes(nodes: DataFrame, edges: DataFrame, tally: DataFrame | None = None) -> DataFrame:
    """(file, n_classes, n_functions, n_docstrings, n_edges_to): how much :func:`payloads` lists, without the lists.

    ``tally`` (src, kind, n) has entities that are counted already and so aren't among ``edges``.
    """
    ends = nodes.select(F.col("id").alias("dst"), "kind")
    sorts = edges.select("src", "dst").distinct().join(ends, "dst").groupBy("src", "kind").agg(F.count("*").alias("n"))
    if tally is not None:
        sorts = sorts.unionByName(tally.select("src", "kind", "n"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    told = sorts.groupBy("src").agg(
        total(F.col("kind") == "class").alias("n_classes"),
        total(F.col("kind").isin("function", "entity")).alias("n_functions"),
        total(F.coalesce(F.col("kind"), F.lit("")) == "").alias("n_edges_to"),
    )
    docs = F.coalesce(F.size("docstrings"), F.lit(0)) if "docstrings" in nodes.columns else F.lit(0)
    files = nodes.where(is_file(F.col("external"), F.col("kind"))).select(F.col("id").alias("file"), F.greatest(docs, F.lit(0)).cast("long").alias("n_docstrings"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.join(told, F.col("file") == F.col("src"), "left").select("file", n("n_classes"), n("n_functions"), "n_docstrings", n("n_edges_to"))


def concurrency(asked: object, default: int = 2, most: int = 5) -> int:
    """Workers to run: what was asked for if it is a number from 1 on, ``most`` at most."""
    try:
        n = int(str(asked))
    except ValueError:
        return default
    return min(n, most) if n >= 1 else default


class TooManyRequests(Exception):
    """The service asked for a pause."""


class TokenBucket:
    """Lets through ``per_minute`` calls a minute, all of them at once if none went before."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most = self.held = float(per_minute)
        self.per_second = per_minute / 60.0
        self.clock, self.sleep, self.at, self.lock = clock, sleep, clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.held = min(self.most, self.held + (now - self.at) * self.per_second)
            self.at = now
            if self.held < 1:
                wait = (1 - self.held) / self.per_second
                self.sleep(wait)
                self.held, self.at = 1.0, self.at + wait
            self.held -= 1


def call_with_retry(call: Callable[[], str], bucket: TokenBucket | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result; a pause is waited for up to four times, doubling, and any other failure passes on at once."""
    for attempt in range(ATTEMPTS):
        if bucket is not None:
            bucket.take()
        try:
            return call()
        except TooManyRequests:
            if attempt == ATTEMPTS - 1:
                raise
            sleep(min(FIRST_WAIT * 2**attempt, LONGEST_WAIT))
    raise AssertionError


def map_concurrently(items: Iterable, workers: int, run: Callable, progress: Callable[[int], None] | None = None) -> list[tuple[object, Exception | None]]:
    """(result, failure) of each item, in order."""
    done, lock = 0, threading.Lock()

    def one(item):
        nonlocal done
        try:
            out = run(item), None
        except Exception as e:  # noqa: BLE001  failures are results here
            out = None, e
        with lock:
            done += 1
            if progress:
                progress(done)
        return out

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return list(pool.map(one, items))


PROMPT = (
    "You describe the architecture of software. You are given a group of files that belong together, as JSON: each file's classes, functions, "
    "doc comments and the files it imports, taken from its syntax. Say shortly what the group does as a whole and what each file is for. "
    "Keep to the facts given, and write no code."
)
TEMPERATURE, MOST_TOKENS = 0.3, 1024


def request(payload: list[dict], model: str) -> dict:
    """What is sent for one batch: the prompt and the payload as chat messages, with the sampling parameters."""
    talk = [{"role": "system", "content": PROMPT}, {"role": "user", "content": json.dumps(payload, indent=2, ensure_ascii=False)}]
    return {"model": model, "messages": talk, "temperature": TEMPERATURE, "max_tokens": MOST_TOKENS}


def service(post: Callable[[dict], tuple[int, str]], model: str) -> Callable[[list[dict]], str]:
    """A call for :func:`summarise` over ``post``, which sends a request and gives status and body."""

    def call(payload: list[dict]) -> str:
        status, body = post(request(payload, model))
        if status == 429:
            raise TooManyRequests("rate limited")
        if not 200 <= status < 300:
            raise RuntimeError(f"the service answered {status}: {body}")
        choices = json.loads(body).get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ""

    return call


def summarise(nodes: DataFrame, edges: DataFrame, call: Callable[[list[dict]], str], workers: int = 2, bucket: TokenBucket | None = None, only: list[dict] | None = None) -> tuple[DataFrame, list[dict]]:
    """(``nodes`` with ``semantic_summary``, failed batches): one call for each batch of files.

    The call is the caller's, as the service is; the driver makes the calls
    and holds the payloads of some batches at a time. ``only`` are failed
    batches of an earlier run; they are then tried alone.
    """
    spark = nodes.sparkSession
    names = ("ast_classes", "ast_functions", "ast_docstrings", "graph_edges_to")
    if only is None:
        placed = batches(nodes).withColumnRenamed("batch", "in_community")
        index = numbered(placed.select("community", "in_community").distinct(), "community", "in_community", name="index")
        placed = stored(placed.alias("a").join(index.alias("b"), F.expr("a.community <=> b.community and a.in_community = b.in_community")).select("index", "id"))
        told = placed.join(payloads(nodes, edges).withColumnRenamed("file", "id"), "id")
        grouped = told.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("id", *names))).alias("files"))
        total = grouped.count()
        todo = ({"index": r["index"], "batch": [f.id for f in r.files], "payload": [{"file": f.id, **{k: f[k] for k in names}} for f in r.files]} for r in grouped.orderBy("index").toLocalIterator())
    else:
        total = len(only)
        todo = (dict(t) for t in only)
        placed = spark.createDataFrame([(t["index"], i) for t in only for i in t["batch"]], "index long, id string")
    texts, failed = [], []
    while some := list(islice(todo, workers * 16)):
        for t, (text, e) in zip(some, map_concurrently(some, workers, lambda t: call_with_retry(lambda: call(t["payload"]), bucket))):
            if e is None:
                texts.append((t["index"], text))
            else:
                failed.append({**t, "error": str(e), "totalClusters": t.get("totalClusters", total)})
    summary = placed.join(spark.createDataFrame(texts, "index long, told string"), "index").select("id", "told")
    old = F.col("semantic_summary") if "semantic_summary" in nodes.columns else F.lit(None).cast("string")
    return nodes.join(summary, "id", "left").withColumn("semantic_summary", F.coalesce("told", old)).drop("told"), failed


def read_settings(path: str) -> dict:
    """Saved settings, none if they can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        return held if isinstance(held, dict) else {}
    except (OSError, ValueError):
        return {}


def credentials(path: str, env: Mapping[str, str], key_name: str, model: str | None = None, reset: bool = False, ask: Callable[[str], str | None] | None = None) -> tuple[str, str] | None:
    """(key, model): the key from the environment before the saved one, the model as given before the saved one.

    What is missing is asked for and saved; without an answer there is None.
    """
    saved = {} if reset else read_settings(path)
    if model:
        saved["model"] = model
    key = env.get(key_name) or saved.get("apiKey") or (ask("key") if ask else None)
    named = saved.get("model") or (ask("model") if ask else None)
    if not key or not named:
        return None
    if not env.get(key_name):
        saved["apiKey"] = key
    saved["model"] = named
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump(saved, f, indent=2)
    return key, named
