"""Answer vectors with fixed slots, and the merge that lets a candidate change answers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import SLOTS, base_id, choice_letters, strip_markdown


def slot(qid: Column, slots: int = SLOTS) -> Column:
    """The slot of an id, from 0, or null where it is out of range or no number."""
    at = base_id(qid) - 1
    return F.when(at.between(0, slots - 1), at)


def choice_vector(rows: DataFrame, keys: list[str], qid: str, answer: str, order: str, slots: int = SLOTS) -> DataFrame:
    """(keys, ans): an array of ``slots`` answers, empty where there is none; of two answers for a slot the later stays."""
    placed = rows.withColumn("__slot", slot(F.col(qid), slots)).filter("__slot is not null")
    last = placed.groupBy(*keys, "__slot").agg(F.max_by(answer, order).alias("__a"))
    held = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__slot", "__a"))).alias("__m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit("")))
    return rows.select(*keys).distinct().join(held, keys, "left").select(*keys, F.coalesce(vector, F.array_repeat(F.lit(""), slots)).alias("ans"))


def guarded_choices(original: Column, candidate: Column) -> Column:
    """The original vector, each place replaced by the candidate's valid choice there; the length stays."""
    return F.transform(original, lambda old, i: F.coalesce(F.nullif(choice_letters(F.get(candidate, i)), F.lit("")), old))


def guarded_questions(original: Column, candidate: Column) -> Column:
    """The original questions (index, title, answer), each answer replaced by the candidate's at that place, Markdown taken off; null keeps the old one."""

    def merged(old: Column, i: Column) -> Column:
        new = F.get(candidate, i)["answer"]
        return F.struct(old["index"].alias("index"), old["title"].alias("title"), F.when(new.isNotNull(), strip_markdown(new)).otherwise(old["answer"]).alias("answer"))

    return F.transform(original, merged)


def guarded_context(original: Column, candidate: Column) -> Column:
    """A context (see ``plans.documents.CONTEXT``) with the candidate's answers; all else stays. A null candidate changes nothing."""
    fixed = [original[c].alias(c) for c in ("homework_name", "class_name", "student_id", "name")]
    choices = F.when(candidate["ans"].isNull(), original["ans"]).otherwise(guarded_choices(original["ans"], candidate["ans"]))
    texts = F.when(candidate["questions"].isNull(), original["questions"]).otherwise(guarded_questions(original["questions"], candidate["questions"]))
    made = F.struct(*fixed, choices.alias("ans"), texts.alias("questions"), original["links"].alias("links"))
    return F.when(candidate.isNull(), original).otherwise(made)
