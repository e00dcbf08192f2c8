"""Rendering contexts to text and to DOCX files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.markdown import blocks
from folioflow.functions.text import NO_TITLE, safe_name
from folioflow.sinks.docx import docx


def rendered(context: Column) -> Column:
    """A context as plain text: heading, numbered choices that are set, questions with their blocks, links."""
    ans = F.array_join(F.filter(F.transform(context["ans"], lambda a, i: F.when(a != "", F.concat_ws(". ", i + 1, a))), lambda x: x.isNotNull()), "\n")
    row = lambda cells: F.array_join(cells, " | ")
    body = lambda q: F.array_join(F.transform(blocks(q["answer"]), lambda b: F.when(b["kind"] == "table", F.array_join(F.transform(b["cells"], row), "\n")).otherwise(b["text"])), "\n")
    questions = F.array_join(F.transform(context["questions"], lambda q: F.concat(F.concat_ws(". ", q["index"], q["title"]), F.lit("\n"), body(q))), "\n\n")
    return F.concat_ws("\n\n", context["homework_name"], F.concat_ws(" ", context["class_name"], context["student_id"], context["name"]), ans, questions, context["links"])


def write_documents(contexts: DataFrame, path: str, mode: str = "error") -> None:
    """(doc_id, file_name, text) as Parquet; Spark's commit stands for the retries a plain file needs."""
    name = safe_name(F.coalesce(F.col("context.homework_name"), F.lit(NO_TITLE)))
    contexts.select("doc_id", name.alias("file_name"), rendered(F.col("context")).alias("text")).write.mode(mode).parquet(path)


def docx_files(contexts: DataFrame) -> DataFrame:
    """(doc_id, file_name, content): each context (doc_id, context) as a DOCX file, with its answers' tables as tables."""
    told = F.transform("context.questions", lambda q: F.struct(F.concat_ws(". ", q["index"], q["title"]).alias("title"), blocks(q["answer"]).alias("blocks")))
    choices = F.filter(F.transform("context.ans", lambda a, i: F.when(a != "", F.concat_ws(". ", i + 1, a))), lambda x: x.isNotNull())
    name = F.coalesce("context.homework_name", F.lit(NO_TITLE))
    lines = F.filter(F.array(F.concat_ws(" ", "context.class_name", "context.student_id", "context.name")), lambda x: x != "")
    rows = contexts.select("doc_id", safe_name(name).alias("file_name"), name.alias("title"), lines.alias("lines"), choices.alias("choices"), told.alias("questions"), F.split(F.coalesce("context.links", F.lit("")), "\n").alias("links"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = [docx(r["title"], r["lines"], r["choices"], r["questions"], [x for x in r["links"] if x]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "file_name", "content"])

    return rows.mapInArrow(run, "doc_id string, file_name string, content binary")


def write_docx(context: dict, template: str, target: str) -> str:
    """One document through a template and ``docxtpl``, where that library is installed; ``docx_files`` needs neither."""
    from docxtpl import DocxTemplate

    document = DocxTemplate(template)
    document.render(context)
    document.save(target)
    return target


def counts_per_kind(questions: DataFrame) -> DataFrame:
    """Questions per document and kind, for the log."""
    return questions.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
