"""Providers: what answers, reviews and searches. Those here are deterministic and work offline.

A provider takes a DataFrame of requests and returns one of replies, so a real one can batch its calls in
``mapInPandas`` and come with its own clients per partition. A reply's text may be null: the call failed.
"""

from __future__ import annotations

import ast
import json
import operator
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import FAILURE
from folioflow.operators.references import HITS, most_shared
from folioflow.tables import Tables, spread

#: Calls under way in a partition, attempts of a call, turns of a conversation with tools, and what a wait of a second is made to last.
AT_ONCE, ATTEMPTS, TURNS, PAUSE = 4, 3, 10, 1.0

#: (doc_id, prompt, parts, ids, round) -> (doc_id, reply), one reply for all pending questions of a document.
Solver = Callable[[DataFrame], DataFrame]
#: (doc_id, qid, answer, prompt, parts, round) -> (doc_id, qid, review); no row where a call failed.
Reviewer = Callable[[DataFrame], DataFrame]


def offline_solver(requests: DataFrame) -> DataFrame:
    """For trial runs: ``A`` for every item, which is a choice and a text."""
    items = F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit("").alias("analysis"), F.lit("A").alias("answer")))
    return requests.select("doc_id", F.to_json(F.struct(items.alias("results"), items.alias("answers"))).alias("reply"))


def offline_reviewer(requests: DataFrame) -> DataFrame:
    """For trial runs: passes whatever isn't empty."""
    return requests.select("doc_id", "qid", F.when(F.col("answer") != "", "PASS").otherwise("empty").alias("review"))


class Pace:
    """At most ``per_second`` calls begin in a second, however many threads make them."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def __call__(self) -> None:
        with self.lock:
            at = max(time.monotonic(), self.next)
            self.next = at + self.gap
        if (rest := at - time.monotonic()) > 0:
            time.sleep(rest)


def calls(
    requests: DataFrame, connect: Callable[[], Callable], keys: str, reply: str = "reply", messages: Callable[[dict], list[dict]] | None = None,
    at_once: int = AT_ONCE, per_second: float | None = None, attempts: int = ATTEMPTS, turns: int = TURNS, pause: float = PAUSE,
) -> DataFrame:
    """(keys, ``reply``, attempts, error): a row for each request, with how many calls it took and, where all failed, why.

    ``connect`` makes one client per partition, on the executor. With ``messages``, which makes a request's messages, the client is called with
    a history and its tool calls are answered (``converse``); without, it is called with the request as a dictionary and
    gives the reply. A partition has at most ``at_once`` calls under way and begins at most ``per_second``; connection
    errors are tried again after growing waits, others aren't. Replies go on as they come in, a few requests at a time.
    """
    names = [x.split()[0] for x in keys.split(", ")]
    schema = pa.schema([*(pa.field(n, pa.string()) for n in (*names, reply)), pa.field("attempts", pa.int32()), pa.field("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        client, pace = None, Pace(per_second)
        with ThreadPoolExecutor(at_once) as pool:

            def ask(request: dict) -> dict:
                n = 0

                def call(history: list[dict]) -> dict:
                    nonlocal n
                    pace()
                    n += 1
                    return client(history) if messages else {"content": client(request)}

                told = {k: request[k] for k in names}
                try:
                    said = converse(call, messages(request) if messages else [], turns, attempts, lambda s: time.sleep(s * pause))
                    return told | {reply: said.get("content"), "attempts": n, "error": None}
                except Exception as e:  # noqa: BLE001  one request's failure is a row, not the job's end
                    return told | {reply: None, "attempts": n, "error": f"{type(e).__name__}: {e}"}

            for batch in batches:
                client = client or connect()
                for at in range(0, batch.num_rows, 8 * at_once):
                    made = list(pool.map(ask, batch.slice(at, 8 * at_once).to_pylist()))
                    yield pa.RecordBatch.from_pylist(made, schema)

    return requests.mapInArrow(run, f"{keys}, {reply} string, attempts int, error string")


def called(requests: DataFrame, connect: Callable[[], Callable], keys: str, reply: str = "reply", failures: Callable[[DataFrame], DataFrame] | None = None, **settings) -> DataFrame:
    """(keys, ``reply``): the replies of ``calls`` that came. ``failures`` takes all rows, with attempts and errors, and gives them back, for instance as a
    written table; without it those of failed calls are left out unseen."""
    rows = calls(requests, connect, keys, reply, **settings)
    return (failures(rows) if failures else rows).filter("error is null").select(*(x.split()[0] for x in keys.split(", ")), reply)


def once(search: Callable[[DataFrame], DataFrame], tables: Tables, name: str = "hits") -> Callable[[DataFrame], DataFrame]:
    """``search`` ((doc_id, qid, query) -> (doc_id, qid, rank, title, content), and ``error`` where it tells one) asked once for each text of a query; its hits are written and joined back to all that asked."""

    def run(questions: DataFrame) -> DataFrame:
        keyed = questions.select("doc_id", "qid", F.sha2(F.coalesce("query", F.lit("")), 256).alias("text"), F.coalesce("query", F.lit("")).alias("query"))
        each = keyed.groupBy("text").agg(F.first("query").alias("query")).select(F.lit("").alias("doc_id"), F.col("text").alias("qid"), "query")
        found = search(each)
        hits = tables.write(found.select(F.col("qid").alias("text"), *(c for c in ("rank", "title", "content", "error") if c in found.columns)), name)
        return keyed.drop("query").join(hits, "text").drop("text")

    return run


def words(text) -> Column:
    """The distinct lower-cased words of a text, of any length."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{Alnum}]+"), lambda x: x != ""))


def corpus_search(questions: DataFrame, corpus: DataFrame, keys: list[str], k: int = HITS, **settings) -> DataFrame:
    """(keys, rank, title, content): the documents of ``corpus`` (title, content) that share most words with each question (keys, query); of equal ones the first by title."""
    return most_shared(questions.select(*keys, words(F.col("query")).alias("words")), spread(corpus.select(F.col("title").cast("string"), "content")).withColumn("words", words(F.col("content"))), keys, ["title", "content"], k, **settings)


def service_search(base: str, k: int = HITS, timeout: float = 3600.0, **settings) -> Callable[[DataFrame], DataFrame]:
    """A search ((doc_id, qid, query) -> (doc_id, qid, rank, title, content, error)) by a service: a GET of ``{base}search?q=...&format=json``, whose reply is an object with ``results``.

    The first ``k`` results are hits; a title or content that isn't there is null. A search without results has no row, one
    that failed (no connection after all attempts, a reply of another form) has one row with its ``error``. An error's status counts for
    nothing where its body is such an object. Queries are encoded, so marks such as ``&`` in them do no harm. ``settings`` are those of
    ``calls``; each run of the result asks anew, so go through ``once``.
    """
    if not base.startswith(("http://", "https://")):
        raise ValueError(f"not the address of a service: {base}")

    def connect() -> Callable[[dict], str]:
        told = lambda value: None if value is None else str(value)

        def client(request: dict) -> str:
            try:
                with urlopen(f"{base}search?{urlencode({'q': request['query'] or '', 'format': 'json'})}", timeout=timeout) as answer:
                    body = answer.read()
            except HTTPError as e:
                body = e.read()
            except URLError as e:
                raise ConnectionError(str(e.reason)) from e
            found = json.loads(body).get("results", [])[:k]
            return json.dumps([{"title": told(x.get("title")), "content": told(x.get("content"))} for x in found])

        return client

    def run(questions: DataFrame) -> DataFrame:
        rows = calls(questions.select("doc_id", "qid", "query"), connect, "doc_id string, qid string", **settings)
        hits = F.from_json("reply", "array<struct<title:string,content:string>>")
        each = rows.select("doc_id", "qid", "error", F.posexplode_outer(hits).alias("at", "hit")).filter("at is not null or error is not null")
        return each.select("doc_id", "qid", (F.col("at") + 1).alias("rank"), "hit.title", "hit.content", "error")

    return run


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg}


def arithmetic(expression: str) -> float | int:
    """The value of an expression of numbers and + - * / // %; all else raises. The only tool a provider is given: no code is run."""

    def value(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        raise ValueError("only numbers and + - * / // % are allowed")

    return value(ast.parse(expression, mode="eval").body)


TOOLS = {"arithmetic": lambda arguments: str(arithmetic(arguments.get("expression", "")))}


def use_tool(name: str, arguments: str) -> str:
    """The result of a tool call; unknown tools and failures are told as text, bad arguments count as none."""
    try:
        given = json.loads(arguments)
    except ValueError:
        given = {}
    if name not in TOOLS:
        return f"unknown tool: {name}"
    try:
        return TOOLS[name](given if isinstance(given, dict) else {})
    except Exception as e:  # noqa: BLE001
        return f"{FAILURE}{e}"


def converse(call: Callable[[list[dict]], dict], messages: list[dict], turns: int = 10, attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> dict:
    """A model call with tools: at most ``turns`` turns, each tried ``attempts`` times on connection errors with growing waits. The history is copied."""
    history, reply = list(messages), {}
    for _ in range(turns):
        for n in range(attempts):
            try:
                reply = call(history)
                break
            except (ConnectionError, TimeoutError):
                if n == attempts - 1:
                    raise
                wait(min(60.0, 2.0 * (n + 1)))
        calls = reply.get("tool_calls") or []
        if not calls:
            return reply
        history.append({"role": "assistant", **reply})
        history += [{"role": "tool", "tool_call_id": c["id"], "name": c["name"], "content": use_tool(c["name"], c.get("arguments", ""))} for c in calls]
    return reply
