"""From files to rendered documents: text and images of the items, answers, feedback, files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import BUNDLE_LIMIT, NO_REFERENCES, path_stem
from folioflow.operators import images as I
from folioflow.operators import segments as S
from folioflow.operators.references import bundle, search_context
from folioflow.plans import parsing
from folioflow.plans.documents import contexts_of, feedback_rounds, link_lines, link_requests
from folioflow.plans.rounds import held, solve, vectors_of
from folioflow.plans.stages import content_key, items_key, staged
from folioflow.sinks.files import save_files
from folioflow.sinks.render import counts_per_kind, docx_files, write_documents
from folioflow.sources import files as sources
from folioflow.sources import providers
from folioflow.tables import Tables


@dataclass
class Providers:
    """What answers. Unset ones work offline: items are split by rules, there is no search, link or feedback.

    ``link_prompt`` is the path of a text that goes with each programming item; ``version`` tells providers apart whose answers may differ.
    """

    solver: providers.Solver = providers.offline_solver
    reviewer: providers.Reviewer = providers.offline_reviewer
    parser: Callable[[DataFrame], DataFrame] | None = None
    search: Callable[[DataFrame], DataFrame] | None = None
    editor: Callable[[DataFrame], DataFrame] | None = None
    links: DataFrame | None = None
    feedback: DataFrame | None = None
    link_prompt: str | None = None
    raster: Callable[[bytes, int], np.ndarray] = I.layout
    version: str = ""


@dataclass
class Engine:
    """A configured run. ``folder`` takes stage tables and results; executors and driver must see it."""

    spark: SparkSession
    folder: str
    config: sources.Config = field(default_factory=sources.Config)
    providers: Providers = field(default_factory=Providers)

    def read(self, paths: list[str]) -> DataFrame:
        """(doc_id, path, content, modified) of PDF files; the id is the file's name without its ending, and a hash of the folder where two are alike."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(paths)
        named = files.select(path_stem(F.col("path")).alias("stem"), "path", "content", F.col("modificationTime").alias("modified"))
        alike = named.groupBy("stem").count().filter("count > 1").select("stem", F.lit(True).alias("alike"))
        doc_id = F.when(F.col("alike"), F.concat("stem", F.lit("-"), F.substring(F.sha2("path", 256), 1, 8))).otherwise(F.col("stem"))
        return named.join(F.broadcast(alike), "stem", "left").select(doc_id.alias("doc_id"), "path", "content", "modified")

    def parse(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Names, items and (doc_id, error)."""
        pages = sources.pdf_pages_of(files)
        texts = sources.document_text(pages.withColumnRenamed("doc_id", "path")).withColumnRenamed("path", "doc_id")
        errors = pages.filter("error is not null").select("doc_id", "error")
        if self.providers.parser is None:
            names, questions = parsing.split_items(texts)
            return names, questions, errors
        names, questions, more = parsing.items_of_replies(held(self.providers.parser(parsing.parse_requests(texts))))
        return names, questions, errors.unionByName(more)

    def screenshots(self, files: DataFrame, questions: DataFrame) -> DataFrame:
        """(doc_id, qid, path, content): a PNG of each item, from its start to the next over all its pages."""
        spans = held(sources.pdf_spans(files))
        pages = spans.select("doc_id", "page", "height").distinct()
        lines = S.page_lines(spans.filter("text is not null"))
        starts = S.item_starts(lines, questions.select("doc_id", "qid"))
        tight = S.tight_segments(S.page_segments(starts, pages), lines, pages)
        return I.as_png(I.item_images(I.item_crops(tight, files, self.providers.raster)))

    def references(self, pdfs: list[str], texts: list[str]) -> tuple[str, DataFrame]:
        """One text of all references, at most ``BUNDLE_LIMIT`` characters, and the warnings."""
        found, warnings = sources.references(self.spark, pdfs, texts)
        row = bundle(found.withColumn("one", F.lit(1)), ["one"], limit=BUNDLE_LIMIT).first()
        return (row.bundle if row else NO_REFERENCES), warnings

    def answers(self, questions: DataFrame, images: DataFrame, kind: str, references: str) -> DataFrame:
        """Answers of all items of a kind, in all documents. A run that was broken off goes on with the rounds that it committed; a query's text is searched for once."""
        asked = questions.filter(F.col("kind") == kind)
        with Tables(self.spark, tag="search") as searched:
            if self.providers.search:
                hits = providers.once(self.providers.search, searched)(asked.select("doc_id", "qid", F.col("question").alias("query")))
            else:
                hits = self.spark.createDataFrame([], "doc_id string, qid string, rank int, title string, content string")
            return solve(I.with_images(search_context(asked, hits, ["doc_id", "qid"]), images), self.providers.solver, self.providers.reviewer, kind == "choice", references, folder=f"{self.folder}/rounds/{kind}")

    def stage(self, name: str, files: DataFrame, items: DataFrame, make: Callable[[DataFrame], DataFrame], schema: str, *inputs: str) -> DataFrame:
        """A stage's rows for the documents of ``items``; only those are made whose file, items or ``inputs`` aren't those of a kept row."""
        read = files.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("content", 256).alias("file"), (F.unix_micros("modified") / 1e6).alias("changed_at"))
        keyed = read.join(items_key(items, ["doc_id"], ["kind", "pos", "qid", "question"]), "doc_id")
        key = content_key(F.lit(name), F.lit(self.providers.version), F.col("file"), F.col("items"), *(F.lit(x) for x in inputs))
        return staged(Tables(self.spark, f"{self.folder}/stages/{name}"), keyed.select("doc_id", key.alias("key"), "changed_at"), make, schema)

    def links(self, questions: DataFrame) -> DataFrame:
        """(doc_id, links): a line per programming item."""
        given = self.providers.links if self.providers.links is not None else self.spark.createDataFrame([], "doc_id string, qid string, link string")
        return link_lines(questions.filter("kind = 'programming'"), given, ["doc_id"])

    def run(self, paths: list[str], pdfs: list[str] | None = None, texts: list[str] | None = None) -> dict:
        """All stages. Answers are taken from the stage tables for each document whose file, references and items are the same; parsing and images are made anew.

        Writes ``documents`` (text), ``docx`` and ``images`` (tables with the files' bytes) and the files themselves below
        ``folder``; gives those tables, ``contexts``, ``warnings``, ``errors``, ``counts``, ``requests`` (what goes with each
        programming item) and ``metrics``, which the writes observed.
        """
        files = held(self.read(paths))
        names, questions, errors = self.parse(files)
        names, errors = held(names), held(errors)
        own = Tables(self.spark, tag="items")
        questions, metrics = own.observed(questions, "questions", items=F.count(F.lit(1)), **{kind: F.count_if(F.col("kind") == kind) for kind in parsing.KINDS})
        images = held(self.screenshots(files, questions))
        text, warnings = self.references(pdfs or [], texts or [])
        of = lambda kind: questions.filter(F.col("kind") == kind)

        def answered(kind: str) -> DataFrame:
            loops = []

            def make(ids: DataFrame) -> DataFrame:
                loops.append(self.answers(questions.join(ids, "doc_id", "left_semi"), images, kind, text))
                return loops[-1]["answers"]

            rows = held(self.stage(kind, files, of(kind), make, "qid string, pos int, title string, answer string, status string", text))
            for loop in loops:  # what they gave is in the stage's table now
                loop["tables"].close()
            return rows

        choice, short = answered("choice"), answered("short_answer")
        prompt = sources.prompt_text(self.spark, self.providers.link_prompt) if self.providers.link_prompt else ""
        requests = link_requests(of("programming"), prompt)
        if self.providers.links is None:
            links = self.stage("programming", files, of("programming"), lambda ids: self.links(questions.join(ids, "doc_id", "left_semi")), "links string", prompt)
        else:
            links = self.links(questions)
        contexts = held(contexts_of(names, vectors_of(choice), short, links, self.config.identity))
        if self.providers.feedback is not None and self.providers.editor is not None:
            contexts = feedback_rounds(contexts, self.providers.feedback, self.providers.editor)
        write_documents(contexts, f"{self.folder}/documents", "overwrite")
        docx_files(contexts).write.mode("overwrite").parquet(f"{self.folder}/docx")
        images.write.mode("overwrite").parquet(f"{self.folder}/images")
        made = {name: self.spark.read.parquet(f"{self.folder}/{name}") for name in ("documents", "docx", "images")}
        path = F.concat(F.lit("files/"), F.col("doc_id"), F.lit("/"), F.col("file_name")).alias("path")
        save_files(made["docx"].select(path, "content"), self.folder)
        save_files(made["images"].select(F.concat(F.lit("files/"), F.col("path")).alias("path"), "content"), self.folder)
        return made | {"contexts": contexts, "image_map": I.image_map(questions, images), "warnings": warnings, "errors": errors, "counts": counts_per_kind(questions), "requests": requests, "metrics": metrics}
