"""Stage tables: what each document's stage gave, by a key of all that it read, so only what changed is computed again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.plans.documents import fresh
from folioflow.tables import Tables

#: Written batches of a stage before they are put together.
BATCHES = 32
KEYS = ["doc_id", "key"]


def content_key(*parts: Column) -> Column:
    """A hash of all that a document's stage reads; no two lists of parts are told alike, a null is a part of its own."""
    told = [F.concat(F.length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.when(p.isNull(), "n").otherwise("s"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat(*told), 256)


def items_key(items: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, items): a hash of each group's rows in the columns' order, whatever order they come in."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("string").alias(c) for c in columns))))
    return items.groupBy(*keys).agg(F.sha2(F.to_json(rows, {"ignoreNullFields": "false"}), 256).alias("items"))


def stale(asked: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``asked`` (doc_id, key, changed_at) for which ``kept`` (doc_id, key, cached_at) holds nothing with their key that is newer than they are."""
    return asked.join(fresh(kept.select(*KEYS, "cached_at"), asked.select(*KEYS, "changed_at"), KEYS), KEYS, "left_anti")


def staged(tables: Tables, asked: DataFrame, make: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """The rows (doc_id, ``schema``) of a stage for all documents of ``asked`` (doc_id, key, changed_at in epoch seconds).

    ``make`` is called with the stale ones, (doc_id), and not at all where there are none; what it gives is added to ``tables`` as a
    batch, a row for each document with its rows, so documents without any are known too. A batch counts when it was
    committed. Batches are put together when there are ``BATCHES`` of them; of two rows of a document and key the later counts.
    """
    kept_schema = f"doc_id string, key string, cached_at double, rows array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split(None, 1) for c in schema.split(', ')))}>>"
    began = time.time()

    def kept() -> tuple[list[str], DataFrame]:
        names = [n for n in tables.names() if n.startswith("batch-")]
        return names, tables.read(names, kept_schema)

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.max_by(F.struct("cached_at", "rows"), "cached_at").alias("last")).select(*KEYS, "last.*")

    names, held = kept()
    if len(names) > BATCHES:
        tables.write(latest(held), f"batch-{time.time_ns():020d}")
        tables.drop(*names)
        names, held = kept()
    asked = asked.select(F.col("doc_id").cast("string").alias("doc_id"), "key", F.col("changed_at").cast("double").alias("changed_at"))
    todo, n = tables.counted(stale(asked, held), "todo")
    if n:
        made = make(todo.select("doc_id"))
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = made.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("rows"))
        none = F.array().cast(kept_schema.split(", rows ")[1])
        whole = todo.join(rows, "doc_id", "left").select(*KEYS, F.lit(began).alias("cached_at"), F.coalesce("rows", none).cast(kept_schema.split(", rows ")[1]).alias("rows"))
        tables.write(whole, f"batch-{time.time_ns():020d}")
        names, held = kept()
    tables.drop("todo")
    return latest(held.join(asked.select(*KEYS), KEYS, "left_semi")).select("doc_id", F.inline("rows"))
