"""License scans by diagonal voting: word k-grams are joined to template places, offsets that agree vote together.

Each text is split once; the hashes of all its rolling k-grams meet some 1,700 template k-grams in a broadcast
hash join (the templates are constants, so its size doesn't grow with the data), and partial sums per document leave the
scan, so a license that stands in a third of all documents is no hot key. No Python runs on the executors.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import UPPER, table
from folioflow.llm.notices import SENTENCES, TEXTS

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices with labels of this method's own, and the share of their k-grams from which a span counts: whole texts need more, as some differ by a paragraph, those of the GNU licenses by a word.
NOTICES = (*((text, label, 0.6) for text, label in SENTENCES), *((text, label, 0.97 if "gpl" in label else 0.8) for text, label in TEXTS))
#: Diagonals as near as this are one span; a span is at most so many times as long as the notice.
NEAR, STRETCH = 3, 1.5


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[list[str], str, float, bool]]:
    """(words, label, least share, base) of phrases, which count wherever all their words stand, and notices."""
    told = [(text, label, 1.0, True) for text, label in phrases] + [(*notice, False) for notice in notices]
    return [(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)), *facts) for text, *facts in told]


def template_places(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """A row for each k-gram of each template: its hash ``th``, words ``w0`` to ``w2``, template number, place, and the template's facts; and a row of nulls, which the end of each text meets."""
    rows: list[dict] = [{}]
    for t, (words, label, least, base) in enumerate(templates(phrases, notices)):
        n_grams = len(words) - K + 1
        rows += [{"w0": words[p], "w1": words[p + 1], "w2": words[p + 2], "t": t, "p": p, "n_grams": n_grams, "label": label, "least": least, "base": base} for p in range(n_grams)]
    schema = "array<struct<w0:string,w1:string,w2:string,t:int,p:int,n_grams:int,label:string,least:double,base:boolean>>"
    made = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
    return made.withColumn("th", F.xxhash64("w0", "w1", "w2"))


def words_of(text: Column) -> Column:
    """The words ``WORD`` of the text with A-Z lower-cased. Mapping every other ASCII character to a space and splitting takes a fifth of the regex's time."""
    between = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and c != 0x20)
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + between, UPPER.lower() + " " * len(between))
    return F.array_remove(F.split(spaced, " "), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, the places of phrases, ``spans`` (label, start, end, coverage), labels and score.

    Null text counts as empty; rows are kept apart by a number of their own, so repeated and null ids
    give a row each; texts of fewer words than a k-gram match nothing; no rows give none; other columns aren't read.
    A text of any length is split within its row (8 bytes a word beside the words); what of it meets templates is
    sorted in one task, which spills, and its spans are one value.
    """
    places = template_places(docs.sparkSession, phrases, notices)
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    end = F.array(F.xxhash64(F.lit(None).cast("string")))
    # The hashes are a column before they are exploded: rows then pass through the join in generated code, with the words by reference.
    rolled = split.select("row", "doc_id", "words", F.concat(hashes, end).alias("hashes")).select("row", "doc_id", "words", F.posexplode("hashes").alias("i", "h"))
    # The hash finds the place, the words confirm it; the end of a text meets the row of nulls, so each text leaves a row.
    same = F.lit(True)
    for n in range(K):
        same = same & (F.get("words", F.col("i") + n) == F.col(f"w{n}"))
    met = rolled.join(F.broadcast(places), (F.col("h") == F.col("th")) & (F.col("t").isNull() | same)).withColumn("n_words", F.size("words").cast("long"))
    # Votes of a diagonal.
    diagonal = (F.col("i") - F.col("p")).alias("d")
    voted = met.groupBy("row", "doc_id", "n_words", "t", diagonal).agg(F.collect_set("p").alias("places"), F.min("i").alias("first"), F.max("i").alias("last"), F.first("n_grams").alias("n_grams"), F.first("label").alias("label"), F.first("least").alias("least"), F.first("base").alias("base"))
    per = Window.partitionBy("row", "t").orderBy("d")
    gap = F.coalesce((F.col("base") | (F.col("d") - F.lag("d").over(per) > NEAR)).cast("int"), F.lit(1))
    merged = voted.withColumn("gap", gap).withColumn("span", F.sum("gap").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("row", "doc_id", "n_words", "t", "span").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first("n_grams")).alias("coverage"),
        F.min("first").cast("long").alias("start"), (F.max("last") + K).cast("long").alias("end"),
        F.first("n_grams").alias("n_grams"), F.first("label").alias("label"), F.first("least").alias("least"), F.first("base").alias("base"),
    )
    real = (F.col("coverage") >= F.col("least")) & (F.col("end") - F.col("start") <= STRETCH * (F.col("n_grams") + K - 1))
    real = F.coalesce(real, F.lit(False))
    place = real & F.col("base")
    join_sorted = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"), F.max(F.when(place, F.col("start"))).alias("last_word"),
        join_sorted(F.when(place, F.col("label"))).alias("base_labels"), join_sorted(F.when(real, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(real, F.struct("start", "end", "label", "coverage")))).alias("spans"),
    ).drop("row")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle(phrases=PHRASES, notices=NOTICES) -> str:
    """The same as SQL, made from the same constants."""
    rows = ", ".join(f"('{' '.join(words)}', {t}, '{label}', {least}, {str(base).lower()})" for t, (words, label, least, base) in enumerate(templates(phrases, notices)))
    return rf"""
WITH templates(phrase, t, label, least, base) AS (VALUES {rows}),
tw AS (SELECT t, label, least, base, string_split(phrase, ' ') AS w FROM templates),
tg AS (SELECT t, label, least, base, len(w) - 2 AS n_grams, unnest(generate_series(1, len(w) - 2)) AS p, w FROM tw),
tp AS (SELECT t, label, least, base, n_grams, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram FROM tg),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM dw WHERE len(w) > 2),
met AS (SELECT DISTINCT r, t, label, least, base, n_grams, i, p FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM dg) g JOIN tp USING (gram)),
gapped AS (SELECT *, CASE WHEN lag(d) OVER o IS NULL OR d - lag(d) OVER o > CASE WHEN base THEN 0 ELSE {NEAR} END THEN 1 ELSE 0 END AS gap FROM (SELECT *, i - p AS d FROM met) WINDOW o AS (PARTITION BY r, t ORDER BY d, i)),
spanned AS (SELECT *, sum(gap) OVER (PARTITION BY r, t ORDER BY d, i ROWS UNBOUNDED PRECEDING) AS span FROM gapped),
spans AS (SELECT r, t, span, any_value(label) AS label, any_value(base) AS base, any_value(least) AS least, any_value(n_grams) AS n_grams, CAST(count(DISTINCT p) AS DOUBLE) / any_value(n_grams) AS coverage, min(i) - 1 AS s, max(i) - 1 + {K} AS e FROM spanned GROUP BY r, t, span),
real AS (SELECT * FROM spans WHERE coverage >= least AND e - s <= {STRETCH} * (n_grams + {K} - 1)),
per AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM real GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM dw LEFT JOIN per USING (r)
"""


ORACLE = oracle()
