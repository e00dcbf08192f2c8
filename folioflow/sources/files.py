"""File sources: settings, texts, documents with pages, images, and what is there to read."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import SOURCE_LIMIT, strip, truncated
from folioflow.sources import pdf


@dataclass(frozen=True)
class Config:
    """Settings of a run: models by name, the search address and the fixed values that a rendered document shows."""

    models: dict[str, dict[str, str]] = field(default_factory=dict)
    search_url: str = "http://localhost:8089/"
    identity: dict[str, str] = field(default_factory=dict)


def load_config(path: str) -> Config:
    """Settings from a TOML file; a missing file raises ``FileNotFoundError``."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    return Config(data.get("models", {}), data.get("search", {}).get("url", Config.search_url), data.get("identity", {}))


def discovered(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modified) of the files that match, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def text_sources(spark: SparkSession, paths: list[str] | str, limit: int = SOURCE_LIMIT) -> DataFrame:
    """(path, content, error) of whole text files, stripped and cut.

    A file that isn't UTF-8 gives an empty content and its error, a path that isn't there gives no row (see ``absent``); the job goes on.
    """
    there = [p for p in ([paths] if isinstance(paths, str) else paths) if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, content string, error string")
    files = spark.read.format("binaryFile").load(there).select("path", "content")
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(readable, truncated(strip(F.col("content").cast("string")), limit)).otherwise("").alias("content"), F.when(~readable, "the file isn't UTF-8").alias("error"))


def prompt_text(spark: SparkSession, path: str) -> str:
    """A prompt file's whole text, as it is: data for a request, never instructions to this library. A missing file raises ``FileNotFoundError``."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first().value


def _exists(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = held.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(held)
    return found is not None and len(found) > 0


def absent(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, warning) of the paths that aren't there."""
    rows = [(p, "the file isn't there") for p in paths if not _exists(spark, p)]
    return spark.createDataFrame(rows, "path string, warning string")


def chosen(spark: SparkSession, folder: str, pattern: str = "*.pdf", wanted: str | None = None) -> str:
    """The path asked for, or the first by name that ``folder`` holds; where there is none, ``FileNotFoundError``."""
    if wanted:
        if not _exists(spark, wanted):
            raise FileNotFoundError(wanted)
        return wanted
    first = discovered(spark, folder, pattern).limit(1).collect()
    if not first:
        raise FileNotFoundError(f"{folder} holds no {pattern}")
    return first[0].path


def references(spark: SparkSession, pdfs: list[str], texts: list[str], reader=None) -> tuple[DataFrame, DataFrame]:
    """(kind, path, content, ord) of PDF files, then text files, in the order asked for, and (path, warning) of what is missing or can't be read."""
    pages = pdf_pages(spark, [p for p in pdfs if _exists(spark, p)], reader)
    documents = document_text(pages, limit=SOURCE_LIMIT).withColumn("kind", F.lit("pdf"))
    plain = text_sources(spark, texts)
    found = documents.select("kind", "path", "content").unionByName(plain.select(F.lit("md").alias("kind"), "path", "content"))
    order = spark.createDataFrame([(kind, i + n, _ending(p)) for n, (kind, paths) in enumerate((("pdf", pdfs), ("md", texts))) for i, p in enumerate(paths, n * len(pdfs))], "kind string, ord int, ending string")
    placed = found.join(F.broadcast(order), (found.kind == order.kind) & F.endswith(found.path, order.ending)).select(found.kind, "path", "content", "ord")  # one row per file asked for
    unread = pages.filter("error is not null").select("path", F.col("error").alias("warning")).unionByName(plain.filter("error is not null").select("path", F.col("error").alias("warning")))
    return placed.dropDuplicates(["kind", "path", "ord"]), absent(spark, [*pdfs, *texts]).unionByName(unread)


def _ending(path: str) -> str:
    return "/" + path.split(":")[-1].lstrip("/") if "/" in path else "/" + path


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, content, url): files with their data URL."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.withColumn("url", F.concat(F.lit("data:image/png;base64,"), F.base64("content")))


def pdf_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, content) of one or more files or folders."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(paths).select("path", "content")


def pdf_pages_of(files: DataFrame, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(doc_id, page, text, error) of files (doc_id, content); ``reader`` maps bytes to page texts (by default this library's own).

    A file that can't be read gives one row with its error, and the job goes on.
    """
    read = reader or (lambda content: [pdf.page_text(spans) for _, _, spans in pdf.read(content)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.doc_id, batch.content, strict=True):
                try:
                    rows += [(doc_id, i, text or "", None) for i, text in enumerate(read(content))]
                except Exception as e:  # noqa: BLE001  one bad file must not stop the others
                    rows.append((doc_id, None, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select(F.col("doc_id").cast("string"), "content").mapInPandas(run, "doc_id string, page int, text string, error string")


def pdf_pages(spark: SparkSession, paths: list[str] | str, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page, text, error): ``pdf_pages_of`` files or folders."""
    return pdf_pages_of(pdf_files(spark, paths).withColumnRenamed("path", "doc_id"), reader).withColumnRenamed("doc_id", "path")


SPANS = "doc_id string, page int, width double, height double, block_type int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double"


def pdf_spans(files: DataFrame, reader: Callable[[bytes], list] | None = None) -> DataFrame:
    """``SPANS`` of files (doc_id, content): each page's size and its spans with their boxes; a page without text has one row without a block."""
    read = reader or pdf.read

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SPANS.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.doc_id, batch.content, strict=True):
                try:
                    pages = read(content)
                except Exception:  # noqa: BLE001  ``pdf_pages`` tells the error
                    continue
                for page, (width, height, spans) in enumerate(pages):
                    rows += [(doc_id, page, width, height, 0, *span) for span in spans] or [(doc_id, page, width, height, *[None] * 9)]
            yield pd.DataFrame(rows, columns=names).astype({"page": "Int32", "block_type": "Int32", "block": "Int32", "line": "Int32", "span": "Int32"})

    return files.select(F.col("doc_id").cast("string"), "content").mapInPandas(run, SPANS)


def document_text(pages: DataFrame, separator: str = "\n", limit: int | None = None) -> DataFrame:
    """(path, content): a document's pages in order; with ``limit`` stripped and cut, as references are."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    made = pages.groupBy("path").agg(F.array_join(ordered, separator).alias("content"))
    return made if limit is None else made.withColumn("content", truncated(strip(F.col("content")), limit))
