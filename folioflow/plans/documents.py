"""A document from items to a rendered file: context, stage tables, feedback."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import SLOTS, as_json, filled, link_line, link_or, strip
from folioflow.operators.answers import guarded_context
from folioflow.plans.prompts import FEEDBACK
from folioflow.plans.rounds import held

QUESTION = "struct<index:string,title:string,answer:string>"
CONTEXT = f"struct<homework_name:string,class_name:string,student_id:string,name:string,ans:array<string>,questions:array<{QUESTION}>,links:string>"


def link_lines(items: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, links): a line for each item (keys, qid, pos) with its link from ``links`` (keys, qid, link), in order."""
    joined = items.join(links, [*keys, "qid"], "left").withColumn("line", link_line(F.col("qid"), link_or(F.coalesce("link", F.lit("")))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return joined.groupBy(*keys).agg(F.array_join(ordered, "\n").alias("links"))


def link_requests(items: DataFrame, prompt: str) -> DataFrame:
    """(doc_id, qid, prompt): what is put to whoever gives an item's link, the text of ``prompt`` and the item."""
    return items.select("doc_id", "qid", F.concat_ws("\n\n", F.nullif(strip(F.lit(prompt)), F.lit("")), "question").alias("prompt"))


def with_feedback(contexts: DataFrame, replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, context) after all ``replies`` (key, seq, reply), each merged in turn under the guard; replies that are no JSON change nothing.

    A fold over the few replies of one document, inside its row.
    """
    parsed = F.from_json(F.col("reply"), CONTEXT, {"mode": "PERMISSIVE"})
    whole = F.when(F.col("reply").rlike(r"^\s*\{") & F.expr("try_parse_json(reply)").isNotNull(), parsed)
    steps = replies.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", whole.alias("c")))), lambda x: x["c"]).alias("steps"))
    joined = contexts.join(steps, key, "left")
    folded = F.aggregate(F.coalesce("steps", F.array().cast(f"array<{CONTEXT}>")), F.col("context").cast(CONTEXT), lambda c, step: guarded_context(c, step).cast(CONTEXT))
    return joined.select(key, folded.alias("context"))


def before_ok(feedback: DataFrame, key: str = "doc_id") -> DataFrame:
    """Feedback (key, seq, remark) up to the first remark that is only OK, in either case; what follows it isn't read."""
    ends = feedback.filter(F.upper(F.trim("remark")) == "OK").groupBy(key).agg(F.min("seq").alias("end"))
    return feedback.join(ends, key, "left").filter("end is null or seq < end").drop("end")


def feedback_rounds(contexts: DataFrame, feedback: DataFrame, editor: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """(key, context) after each remark of ``feedback`` was given, with the context as it then was, to ``editor`` ((key, prompt) -> (key, reply)) and its reply merged under the guard.

    A loop over the longest list of remarks, whatever the number of documents.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    remarks = held(before_ok(feedback, key).withColumn("turn", turn))
    now = contexts.select(key, F.col("context").cast(CONTEXT).alias("context"))
    for n in range(1, (remarks.agg(F.max("turn")).first()[0] or 0) + 1):
        asked = now.join(remarks.filter(F.col("turn") == n), key)
        prompt = filled(FEEDBACK, context=as_json(F.col("context")), remark=F.col("remark"))
        replies = held(editor(asked.select(key, prompt.alias("prompt"))).select(key, F.lit(n).alias("seq"), "reply"))
        now = held(with_feedback(now, replies, key))
    return now


def contexts_of(names: DataFrame, vectors: DataFrame, short: DataFrame, links: DataFrame, identity: dict[str, str]) -> DataFrame:
    """(doc_id, context): name, the fixed values of ``identity``, the answer vector (empty where there is none), short answers in order, and links."""
    listed = short.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("qid").alias("index"), "title", "answer"))), lambda x: x.dropFields("pos")).alias("questions"))
    joined = names.join(vectors, "doc_id", "left").join(listed, "doc_id", "left").join(links, "doc_id", "left")
    fixed = [F.lit(identity.get(k, "")).alias(c) for c, k in (("class_name", "class"), ("student_id", "id"), ("name", "name"))]
    none = F.array().cast(f"array<{QUESTION}>")
    made = F.struct(F.col("homework_name"), *fixed, F.coalesce("ans", F.array_repeat(F.lit(""), SLOTS)).alias("ans"), F.coalesce("questions", none).alias("questions"), F.coalesce("links", F.lit("")).alias("links"))
    return joined.select("doc_id", made.cast(CONTEXT).alias("context"))


def fresh(kept: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``kept`` (keys, cached_at) that are newer than their source (keys, changed_at); equal times aren't, nor is what has no source."""
    return kept.join(sources, keys).filter("cached_at > changed_at")


def stage_key(stage: str, *inputs: str) -> str:
    """A stage's key: its name and a hash of all that it reads, so equal file names in two folders don't meet."""
    return f"{stage}-{hashlib.sha256(json.dumps(inputs, ensure_ascii=False).encode()).hexdigest()[:24]}"


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], newer_than: float | None = None) -> DataFrame:
    """The stage's table if it is there whole, has rows and is newer than its source (epoch seconds); else it is made and written."""
    path = f"{folder.rstrip('/')}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop) and (newer_than is None or fs.getFileStatus(hadoop).getModificationTime() / 1000 > newer_than):
        found = spark.read.parquet(path)
        if found.limit(1).count():
            return found
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
