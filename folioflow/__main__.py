"""``python -m folioflow [PDF] --reference-pdf P --reference-md M --out FOLDER``: answers and renders the documents of a folder."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from folioflow.plans.run import Engine
from folioflow.sources.files import Config, chosen, load_config


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="folioflow", description="From PDF files with numbered items to rendered documents.")
    parser.add_argument("target", nargs="?", help="a PDF file; the first of the folder by default")
    parser.add_argument("--all", action="store_true", help="all PDF files of the folder")
    parser.add_argument("--folder", default=".", help="where PDF files are looked for")
    parser.add_argument("--reference-pdf", action="append", default=[], help="a PDF file to cite; may be repeated")
    parser.add_argument("--reference-md", action="append", default=[], help="a text file to cite; may be repeated")
    parser.add_argument("--out", default="out", help="where stage tables and results go")
    parser.add_argument("--config", help="a TOML file")
    return parser.parse_args(given)


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit 1 where no PDF file is found. The providers are the offline ones; others are passed to ``Engine``."""
    told = arguments(given)
    spark = spark or SparkSession.builder.appName("folioflow").getOrCreate()
    folder = str(Path(told.folder).resolve()) if "://" not in told.folder else told.folder
    try:
        first = chosen(spark, folder, wanted=told.target)
    except FileNotFoundError as e:
        print(f"no PDF file: {e}", file=sys.stderr)
        return 1
    out = str(Path(told.out).resolve()) if "://" not in told.out else told.out
    made = Engine(spark, out, load_config(told.config) if told.config else Config()).run([folder] if told.all else [first], told.reference_pdf, told.reference_md)
    for row in made["counts"].orderBy("doc_id", "kind").collect():  # a few rows per document asked for
        print(f"{row.doc_id}: {row.n} {row.kind}")
    for row in made["warnings"].collect():
        print(f"{row.path}: {row.warning}", file=sys.stderr)
    for row in made["errors"].collect():
        print(f"{row.doc_id}: {row.error}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
