"""Model replies: strict JSON, several shapes, last of an id wins, and the join to the questions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioflow.functions.text import NO_ANSWER, extract_tag, fenced_json

_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "analysis", "answer")])
REPLY = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("items", T.ArrayType(_ITEM))])


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(REPLY)
def _parsed(replies: pd.Series, keys: pd.Series) -> pd.DataFrame:
    """Strict parsing as ``json.loads`` has it: no built-in reader rejects trailing text and keeps an array's other elements."""
    rows = []
    for reply, names in zip(replies, keys, strict=True):
        try:
            data = json.loads(reply)
        except (TypeError, ValueError):
            rows.append((False, []))
            continue
        if isinstance(data, dict):
            data = next((data[k] for k in names.split(",") if isinstance(data.get(k), list)), [])
        items = data if isinstance(data, list) else []
        rows.append((True, [{"id": "None" if x.get("id") is None else _text(x.get("id")), "analysis": _text(x.get("analysis")), "answer": _text(x.get("answer"))} for x in items if isinstance(x, dict)]))
    return pd.DataFrame(rows, columns=["ok", "items"])


def parsed(reply: Column, keys: tuple[str, ...] = ("results", "ans")) -> Column:
    """``ok`` and ``items`` of a reply, which may stand in a fence; a list is taken as it is, an object's list is under the first of ``keys`` it has."""
    return _parsed(fenced_json(reply), F.lit(",".join(keys)))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(*keys, "last.*")


def answers(replies: DataFrame, keys: tuple[str, ...] = ("results", "ans"), id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(id_cols, qid, thought, answer, pos) from replies (id_cols, reply): tags are taken off, the last of an id wins."""
    items = replies.select(*id_cols, F.posexplode(parsed(F.col("reply"), keys)["items"]).alias("pos", "item"))
    rows = items.select(*id_cols, F.col("item.id").alias("qid"), extract_tag(F.col("item.analysis"), "thought", F.col("item.analysis")).alias("thought"), extract_tag(F.col("item.answer"), "answer", F.trim("item.answer")).alias("answer"), "pos")
    return last_wins(rows, [*id_cols, "qid"], "pos")


def with_answers(questions: DataFrame, found: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), otherwise: str | None = None) -> DataFrame:
    """Each question with its answer; where there is none, ``otherwise`` (null: the question stays pending)."""
    side = found.select(*id_cols, "qid", "answer")
    joined = questions.join(side, [*id_cols, "qid"], "left")
    return joined if otherwise is None else joined.withColumn("answer", F.coalesce("answer", F.lit(otherwise)))


def longest_first(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Of rows with equal keys that with the longest ``text``, the earliest of equals."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.length(text).desc(), order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def final_answers(questions: DataFrame, accepted: DataFrame, keys: tuple[str, ...] = ("qid",), otherwise: str = NO_ANSWER, order: tuple[str, ...] = ()) -> DataFrame:
    """One row per question with the accepted answer or ``otherwise``, in the order of the columns ``order`` (none: in no order)."""
    side = accepted.select(*keys, "answer")
    joined = questions.join(side, list(keys), "left").withColumn("answer", F.coalesce("answer", F.lit(otherwise)))
    return joined.orderBy(*order) if order else joined
