"""Mixing sources to target weights: each document is taken floor(rate) times, and once more by a seeded coin.

Word counts are summed per source (map-side first, so a source with a third of all rows is
no burden), targets follow from the few source rows, and each document draws its own coin from
a hash of its id, so reruns and retried tasks agree. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import Scratch, fresh, space_words, table

MAX_RATE = 3
CYCLE = (1, 2, 3)
SEED = "mix-1"


def source_targets(sized: DataFrame, source: str, size: str, max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes. A target stops at ``max_rate`` times its source's size; what is over goes to the others
    by weight, until none is above. With sources in order of limit by weight this is one pass: a
    source is held at its limit if its share of what its predecessors left is above that.
    """
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), ((rank - 1) % len(CYCLE) + 1).cast("int")).cast("long")
    per = per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_rate).alias("most"))
    every = Window.partitionBy()
    # most / weight, in whole numbers: 6 is divisible by each weight
    before = Window.orderBy(F.expr("most * (6 div weight)"), "weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("held", F.col("most") * open_weight <= F.col("weight") * left)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("held"), F.col("most"))).over(every), F.lit(0))
    rest_weight = F.sum(F.when(~F.col("held"), F.col("weight"))).over(every)
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise((F.col("weight") * rest).cast("double") / rest_weight)
    return per.select("source", "source_size", target.alias("target"))


def coin(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 with 52 random bits, from a hash of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies`` (see ``fresh`` for clashes).

    A null text has size 0. A null source is a source. Rows with one id share a coin. A source without
    words has rate 0. An empty table gives an empty table.
    """
    size, total, target, number, src = fresh(docs, "size", "source_size", "target", "copies", "source")
    sized = docs.withColumn(size, F.size(space_words(F.col(text_col))).cast("long"))
    per = source_targets(sized, source_col, size).select(F.col("source").alias(src), F.col("source_size").alias(total), F.col("target").alias(target))
    per = Scratch(docs.sparkSession, "mixing").cut(per, "sources", keep=True)  # a written table has a known size: where it is small, Spark joins without dealing out the texts
    rate = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(0.0)
    whole = F.floor(rate)
    drawn = whole + (coin(F.col(id_col), seed) < rate - whole).cast("long")
    joined = sized.join(per, F.col(source_col).eqNullSafe(F.col(src)), "left")
    return joined.withColumn(number, drawn).drop(src)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as it is taken, with its own columns."""
    size, total, target, number, each = fresh(docs, "size", "source_size", "target", "copies", "each")
    taken = copies(docs, id_col, text_col, source_col, seed).filter(F.col(number) > 0)
    return taken.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(number)))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    size, total, target, number = fresh(docs, "size", "source_size", "target", "copies")
    return copies(docs).select("doc_id", F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(target).alias("target"), (F.col(number) * F.col(size)).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS most FROM per
), base AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
    CAST(coalesce(sum(most) OVER w, 0) AS BIGINT) AS most_before, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weight_before
  FROM ranked WINDOW w AS (ORDER BY most * (6 // weight), weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (
  SELECT *, most * (all_weight - weight_before) <= weight * (total - most_before) AS held FROM base
), rest AS (
  SELECT *, total - CAST(coalesce(sum(CASE WHEN held THEN most END) OVER (), 0) AS BIGINT) AS rest, CAST(sum(CASE WHEN NOT held THEN weight END) OVER () AS BIGINT) AS rest_weight FROM held
), target AS (
  SELECT source, source_size, CASE WHEN held THEN CAST(most AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) END AS target FROM rest
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
