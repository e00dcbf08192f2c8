"""Answer and review rounds: a bounded loop over a table of pending questions of many documents.

A round is one batch: the solver sees each document's pending questions, the reviewer each answer. Replies are written before
they are read, since a provider may answer otherwise when it is asked twice, and a round is over when its outcome is
committed. Outcomes are only ever added; what is pending follows from questions and outcomes. So a loop whose driver was lost goes on from
its folder with the first round that isn't committed. It runs as often as the slowest document needs, ``rounds`` times at
most, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import NO_ANSWER, NO_REASON, SLOTS, choice_letters, filled, image_parts, passes, strip
from folioflow.operators.answers import choice_vector
from folioflow.operators.results import answers, final_answers, longest_first, with_answers
from folioflow.plans.prompts import CHOICE, QUESTION, REVIEW, SHORT
from folioflow.sources.providers import Reviewer, Solver
from folioflow.tables import Tables

ROUNDS, PATIENCE = 10, 3
OUTCOME = "doc_id string, qid string, pos int, answer string, review string, passed boolean, round int"
KEYS = ["doc_id", "qid"]


def held(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, which all executors and the driver share; only a session on this machine alone may do without one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioflow-"))
    return df.checkpoint()


def requests(pending: DataFrame, choice: bool, references: Column, turn: int) -> DataFrame:
    """(doc_id, prompt, parts, ids, round): one request per document with all its pending questions in order, and their images."""
    line = filled(QUESTION, qid=F.col("qid"), question=F.col("question"), context=F.col("context"), feedback=F.col("feedback"))
    asked = pending.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "qid", line.alias("line"), "images"))).alias("asked"))
    prompt = filled(CHOICE if choice else SHORT, references=references, questions=F.array_join(F.transform("asked", lambda x: x["line"]), "\n"))
    images = F.flatten(F.transform("asked", lambda x: F.coalesce(x["images"], F.array().cast("array<struct<label:string,content:binary>>"))))
    return asked.select("doc_id", prompt.alias("prompt"), image_parts(prompt, images).alias("parts"), F.transform("asked", lambda x: x["qid"]).alias("ids"), F.lit(turn).alias("round"))


def force_longest(best: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """The longest answers seen of what has none accepted."""
    return best.join(accepted.select(*keys), keys, "left_anti")


def reason(review: Column) -> Column:
    """What a failed review says, or the default."""
    return F.coalesce(F.nullif(strip(review), F.lit("")), F.lit(NO_REASON))


def usable(choice: bool) -> Column:
    """Outcomes that are an answer: passed, and for a choice not without letters."""
    return F.col("passed") & (F.col("answer") != "") if choice else F.col("passed")


def stopped(log: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """(doc_id) of the documents with ``patience`` reviewed rounds after the last in which an answer was longer than all before it."""
    before = Window.partitionBy(*KEYS).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("answer")
    grown = F.coalesce(size > F.max(F.when(F.col("review").isNotNull(), size)).over(before), F.lit(True)) & F.col("review").isNotNull()
    last = Window.partitionBy("doc_id")
    told = log.withColumn("grown", grown).withColumn("grew", F.coalesce(F.max(F.when(F.col("grown"), F.col("round"))).over(last), F.lit(0)))
    return told.filter("round > grew").groupBy("doc_id").agg(F.count_distinct("round").alias("still")).filter(F.col("still") >= patience).select("doc_id")


def pending_of(every: DataFrame, log: DataFrame, choice: bool, patience: int = PATIENCE) -> DataFrame:
    """The questions that a next round asks, with what the last failed review said of each. ``log``: all outcomes (``OUTCOME``)."""
    failed = F.col("review").isNotNull() & ~F.col("passed")
    state = log.groupBy(*KEYS).agg(F.bool_or(usable(choice) | F.col("review").isNull()).alias("closed"), F.max_by(reason(F.col("review")), F.when(failed, F.col("round"))).alias("feedback"))
    open_ = every.join(state, KEYS, "left").filter(~F.coalesce("closed", F.lit(False))).select(*KEYS, "pos", "question", "context", "feedback", "images")
    return open_ if choice else open_.join(stopped(log, patience), "doc_id", "left_anti")


def fingerprint(every: DataFrame, *more: object) -> str:
    """One number of questions and settings, whatever the order of rows."""
    n, total = every.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*every.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((n, str(total), *more)).encode()).hexdigest()[:24]


def solve(questions: DataFrame, solver: Solver, reviewer: Reviewer, choice: bool, references: str = "", rounds: int = ROUNDS, patience: int = PATIENCE, folder: str | None = None) -> dict:
    """``answers`` (doc_id, qid, pos, title, answer, status per question, in order), ``log`` (``OUTCOME``: all reviews) and ``tables``, which both read.

    ``questions``: (doc_id, qid, pos, question, context), with ``images`` (label, content) if there are any; without ``doc_id`` they
    are one document's. A document whose reply is missing or no JSON is asked again with what it was asked. Choice answers
    that pass but hold no letter stay pending without new feedback, as do choice questions that a reply lacks; a
    short question's missing answer is reviewed as such. A review without text is a failed one with a default reason;
    a question for which no review came at all is dropped (status ``unreviewed``). Short answers of a document stop after
    ``patience`` reviewed rounds in which none grew, and the longest answers seen are accepted.

    With ``folder``, a loop over the same questions and settings that was broken off there goes on: rounds that were committed and
    replies that were written aren't asked for again. A round's questions and replies are deleted when its outcome is committed;
    outcomes and answers stay until ``tables.close()``.
    """
    spark = questions.sparkSession
    single = "doc_id" not in questions.columns
    images = F.col("images") if "images" in questions.columns else F.lit(None).cast("array<struct<label:string,content:binary>>")
    every = questions.select((F.lit("") if single else F.col("doc_id").cast("string")).alias("doc_id"), "qid", F.col("pos").cast("int").alias("pos"), "question", "context", images.alias("images"))
    tables = Tables(spark, f"{folder.rstrip('/')}/{fingerprint(every, choice, references, rounds, patience)}" if folder else None, "rounds")
    every = tables.read("questions", every.schema) if tables.has("questions") else tables.write(every, "questions")
    cited, keys = F.lit(references), ("results", "ans") if choice else ("answers", "results")
    of = lambda df: (F.lit("") if "doc_id" not in df.columns else F.col("doc_id").cast("string")).alias("doc_id")
    over = []
    while tables.has(name := f"round-{len(over) + 1:04d}"):
        over.append(name)
    log = tables.read(over, OUTCOME)
    for turn in range(len(over) + 1, rounds + 1):
        pending, n = tables.counted(pending_of(every, log, choice, patience), f"pending-{turn:04d}")
        if not n:
            tables.drop(f"pending-{turn:04d}")
            break
        name = f"replies-{turn:04d}"
        if not tables.has(name):
            replies = solver(requests(pending, choice, cited, turn))
            tables.write(replies.select(of(replies), F.col("reply").cast("string").alias("reply")), name)
        found = answers(tables.read(name, "doc_id string, reply string"), keys)
        heard = pending if choice else pending.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
        asked = with_answers(heard, found, otherwise=None if choice else NO_ANSWER).filter("answer is not null")
        request = filled(REVIEW, qid=F.col("qid"), question=F.col("question"), context=F.col("context"), references=cited, answer=F.col("answer"))
        reviews = reviewer(asked.select(*KEYS, "answer", request.alias("prompt"), image_parts(request, F.col("images")).alias("parts"), F.lit(turn).alias("round")))
        told = reviews.select(of(reviews), "qid", F.coalesce("review", F.lit("")).alias("review")).dropDuplicates(KEYS)
        passed = passes(F.col("review"))
        shown = F.when(passed, choice_letters(F.col("answer"))).otherwise(F.col("answer")) if choice else F.col("answer")
        outcome = asked.join(told, KEYS, "left").select(*KEYS, "pos", shown.alias("answer"), "review", passed.alias("passed"), F.lit(turn).alias("round"))
        over.append(f"round-{turn:04d}")
        tables.write(outcome, over[-1])
        log = tables.read(over, OUTCOME)
        tables.drop(f"pending-{turn:04d}", name)
    if not tables.has("answers"):
        accepted = log.filter(usable(choice)).groupBy(*KEYS).agg(F.max_by("answer", "round").alias("answer")).withColumn("status", F.lit("passed"))
        if not choice:
            seen = log.filter("review is not null").join(stopped(log, patience), "doc_id", "left_semi")
            forced = force_longest(longest_first(seen, KEYS, "answer", "round"), accepted, KEYS)
            accepted = accepted.unionByName(forced.select(*KEYS, "answer", F.lit("longest").alias("status")))
        unreviewed = log.filter("review is null").select(*KEYS).distinct().withColumn("unreviewed", F.lit(True))
        final = final_answers(every.join(accepted.select(*KEYS, "status"), KEYS, "left"), accepted, tuple(KEYS), "" if choice else NO_ANSWER)
        status = F.coalesce("status", F.when(F.col("unreviewed"), "unreviewed"), F.lit("open"))
        tables.write(final.join(unreviewed, KEYS, "left").select(*KEYS, "pos", F.col("question").alias("title"), "answer", status.alias("status")), "answers")
    return {"answers": tables.read("answers").orderBy("doc_id", "pos"), "log": log, "tables": tables}


def vectors_of(found: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, ans): each document's answers as a vector; ids out of range are left out, the later of two stays."""
    return choice_vector(found.filter("answer <> ''"), ["doc_id"], "qid", "answer", "pos", slots)


def vector_of(found: DataFrame, slots: int = SLOTS) -> list[str]:
    """The vector of the only document of ``found``."""
    row = vectors_of(found, slots).first()
    return row.ans if row else [""] * slots
