"""From raw documents to training tokens: quality rules, near-dedup, secrets, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import mixing, near_dup, pieces, quality_rules, secrets
from folioflow.llm.common import Scratch, drop_tables, keep, owned, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return near_dup.keep_one(docs, numerator=80, denominator=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Expectation-maximisation, components and piece ids can't be told in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's tables go when the next one's are written, all of them if the run fails."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    with owned() as held:
        for name, stage in STAGES[:-1]:
            docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
            written = held.pop()
            drop_tables(held)
            held.append(written)
        made = STAGES[-1][1](spark, docs, sf_dir)
    keep(held)  # the result reads the last of them
    return made
