"""From a document's text to its title and items: by rules, or from a model's reply."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.markdown import lines
from folioflow.functions.text import NO_TITLE, fenced_json, filled, item_start, strip
from folioflow.operators.carry import carried
from folioflow.plans.prompts import PARSE

KINDS = ("choice", "short_answer", "programming")
#: What a heading says of the items below it, and what an item says of itself.
HEADINGS = (("choice", "(?i)choice|选择"), ("programming", "(?i)programming|coding|编程|程序"), ("short_answer", "(?i)short answer|essay|简答|问答"))
HEADING_LENGTH = 40
OPTION, OPTIONS = r"(?U)^\s*[A-H]\s*[.、．):]", 2
QUESTION = "doc_id string, kind string, pos int, qid string, question string"


def split_items(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, homework_name) and ``QUESTION`` rows of whole texts (doc_id, content).

    An item begins at a numbered line and goes to the next one or to a heading. Its kind is that of the heading above it, else
    choice if it has two options or more, programming if it speaks of a program, else short answer. The name is the
    first line that isn't blank. What an item's lines must know of those above is carried over blocks of lines, so one
    long document is spread; an item's own lines are one value.
    """
    each = texts.select(F.col("doc_id").cast("string"), F.posexplode(lines(F.coalesce("content", F.lit("")))).alias("at", "line")).filter(strip(F.col("line")) != "")
    names = each.groupBy("doc_id").agg(F.min_by(strip(F.col("line")), "at").alias("homework_name"))
    number = item_start(F.col("line"))
    told = F.coalesce(*(F.when(F.col("line").rlike(pattern), kind) for kind, pattern in HEADINGS))
    heading = F.when((F.length(strip(F.col("line"))) <= HEADING_LENGTH) & number.isNull() & ~F.col("line").rlike(OPTION), told)
    marked = each.select("*", number.alias("qid"), heading.alias("heading"))
    edge = F.col("qid").isNotNull() | F.col("heading").isNotNull()
    held = carried(marked, ["doc_id"], "at", counts={"item": edge}, lasts={"section": F.col("heading")})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    items = held.groupBy("doc_id", "item").agg(F.min_by("qid", "at").alias("qid"), F.min("at").alias("at"), F.first("section").alias("section"), strip(body).alias("question"), F.count_if(F.col("line").rlike(OPTION)).alias("options")).filter("qid is not null")
    own = F.when(F.col("options") >= OPTIONS, "choice").when(F.col("question").rlike(HEADINGS[1][1]), "programming").otherwise("short_answer")
    kinds = carried(items.withColumn("kind", F.coalesce("section", own)), ["doc_id", "kind"], "at", counts={"nth": F.lit(True)})
    return names, kinds.select("doc_id", "kind", (F.col("nth") - 1).cast("int").alias("pos"), F.translate("qid", "０１２３４５６７８９", "0123456789").alias("qid"), "question")


def parse_requests(texts: DataFrame) -> DataFrame:
    """(doc_id, prompt) that ask a provider to split each text."""
    return texts.select(F.col("doc_id").cast("string"), filled(PARSE, text=F.col("content")).alias("prompt"))


_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "question")])
_STRUCTURE = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("homework_name", T.StringType()), *(T.StructField(k, T.ArrayType(_ITEM)) for k in KINDS)])


@F.pandas_udf(_STRUCTURE)
def _structure(replies: pd.Series) -> pd.DataFrame:
    rows = []
    for reply in replies:
        try:
            data = json.loads(reply)
        except (TypeError, ValueError):
            data = None
        if not isinstance(data, dict):
            rows.append((False, None, [], [], []))
            continue
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        lists = [[{"id": "None" if x.get("id") is None else text(x["id"]), "question": text(x.get("question")) or ""} for x in data.get(k) or [] if isinstance(x, dict)] for k in KINDS]
        rows.append((True, text(data.get("homework_name")), *lists))
    return pd.DataFrame(rows, columns=["ok", "homework_name", *KINDS])


def items_of_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names, ``QUESTION`` rows, and (doc_id, error) of what can't be read, from replies (doc_id, reply)."""
    found = replies.select(F.col("doc_id").cast("string"), _structure(fenced_json(F.col("reply"))).alias("s"))
    each = lambda kind: found.select("doc_id", F.lit(kind).alias("kind"), F.posexplode(f"s.{kind}").alias("pos", "q")).select("doc_id", "kind", "pos", F.col("q.id").alias("qid"), F.col("q.question").alias("question"))
    questions = each(KINDS[0]).unionByName(each(KINDS[1])).unionByName(each(KINDS[2]))
    names = found.filter("s.ok").select("doc_id", F.coalesce("s.homework_name", F.lit(NO_TITLE)).alias("homework_name"))
    return names, questions, found.filter("not s.ok").select("doc_id", F.lit("the structure reply is no JSON object").alias("error"))
