"""Reference bundles and search context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import BUNDLE_LIMIT, FAILURE, NO_CONTEXT, NO_REFERENCES, SEPARATORS, SOURCE_LIMIT, SPACES, bare, hit_line, reference_block, truncated
from folioflow.tables import Tables

HITS = 5
#: Questions that meet a mask at once.
GROUP = 4096
#: Words that are bits of masks; bytes of words, and questions, that are broadcast (after they were counted) at most.
FREQUENT, SENT, SENT_QUESTIONS = 256, 32 << 20, 200_000
_SMALL = ("tinyint", "smallint", "int", "bigint", "date", "timestamp")
BETWEEN = "\n\n"
#: Parts that a group of sources is cut in before it is put together.
PARTS = 64


def bundle(sources: DataFrame, keys: list[str], source_limit: int = SOURCE_LIMIT, limit: int = BUNDLE_LIMIT, spaces: str = SPACES + SEPARATORS, groups: DataFrame | None = None, otherwise: str | None = NO_REFERENCES) -> DataFrame:
    """(keys, bundle): blocks of the sources (keys, kind, path, content, ord) in order, empty ones left out, both cut to their limits; ``spaces`` are trimmed. Of ``groups`` (keys; all by default), those without a block give ``otherwise``.

    A block within the limit in its group, with what stands between it and the one before, is within it in each part of
    the group too. So groups are first dealt into ``PARTS`` and cut there, and what one task collects is bounded by the limit, not by the group.
    """
    text = truncated(bare(F.coalesce("content", F.lit("")), spaces), source_limit)
    told = sources.withColumn("__c", text).filter("__c <> ''").select(*keys, "ord", "path", reference_block(F.col("kind"), F.col("path"), F.col("__c")).alias("__b"))
    dealt = told.withColumn("__part", F.pmod(F.xxhash64("ord", "path"), F.lit(PARTS))).filter("__b is not null")

    def within(rows: DataFrame, *of: str) -> DataFrame:
        before = Window.partitionBy(*of).orderBy("ord", "path", "__b").rowsBetween(Window.unboundedPreceding, -1)
        used = F.coalesce(F.sum(F.length("__b") + len(BETWEEN)).over(before), F.lit(0))
        return rows.withColumn("__used", used).filter(F.col("__used") - len(BETWEEN) < limit).drop("__used")

    first = within(within(dealt, *keys, "__part"), *keys).drop("__part")
    every = first.unionByName((sources if groups is None else groups).select(*keys).distinct(), allowMissingColumns=True)
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("__b").isNotNull(), F.struct("ord", "path", F.col("__b").alias("b"))))), lambda x: x["b"])
    return every.groupBy(*keys).agg(truncated(F.coalesce(F.nullif(F.array_join(ordered, BETWEEN), F.lit("")), F.lit(otherwise)), limit).alias("bundle"))


def top_hits(hits: DataFrame, keys: list[str], order: list, k: int = HITS) -> DataFrame:
    """The first ``k`` hits per key, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def most_shared(asked: DataFrame, held: DataFrame, keys: list[str], order: list[str], k: int = HITS, tables: Tables | None = None, group: int = GROUP) -> DataFrame:
    """(keys, rank, ``order``, n): the ``k`` rows of ``held`` (order, words) that share most words with each row of ``asked`` (keys, words), ties by ``order``; a row that shares none is no hit.

    An inverted index of the words that are asked for, in two parts. The ``FREQUENT`` ones that most questions ask for are bits of a row's mask,
    so what a question shares of them with a row is counted by bits; all rarer ones are postings. Rows that share a rare word are
    found by joining postings, and their sums are whole. What is left is bounded: a row without a rare word shares at most the frequent
    ones, so a question whose k-th sum is above its number of those is done. The others meet one mask at a time, of
    whose rows the first ``k`` can be hits. Which words count as frequent changes the work, never the rows.

    The result reads tables of ``tables``; with none given they stay in the session's shared folder.
    """
    spark, tables = asked.sparkSession, tables or Tables(asked.sparkSession, tag="search")
    questions = tables.write(asked.select(F.struct(*keys).alias("q"), F.explode("words").alias("w")).distinct(), "asked")
    n_questions, size = questions.agg(F.count_distinct("q"), F.sum(F.octet_length("w") + 16)).first()
    sent = lambda df, fits: F.broadcast(df) if fits else df
    small = (size or 0) <= SENT
    types = dict(held.dtypes)
    if all(types[c] in _SMALL for c in order):
        docs, ids = held, order
    else:  # numbers in their order stand for wide columns
        docs, ids = tables.write(held.orderBy(*order).withColumn("__doc", F.monotonically_increasing_id()), "held"), ["__doc"]
    frequent = questions.groupBy("w").count().orderBy(F.desc("count"), "w").limit(FREQUENT).collect()
    bits = [(r.w, i // 64, (1 << i % 64) - (1 << 64) * (i % 64 == 63)) for i, r in enumerate(frequent)]
    vocabulary = questions.select("w").distinct().join(F.broadcast(spark.createDataFrame(bits, "w string, slot int, bit long")), "w", "left")
    # ``explode`` would have a filter on the words pushed down to the scan, which makes them twice; the join drops the nulls.
    placed = docs.select(*ids, F.explode_outer("words").alias("w")).join(sent(vocabulary, small), "w")
    postings = tables.write(placed.select(*ids, F.when(F.col("slot").isNull(), F.col("w")).alias("w"), "slot", "bit"), "postings")
    slots = range(max(1, -(-FREQUENT // 64)))
    of_doc, of_question = [f"d{i}" for i in slots], [f"q{i}" for i in slots]
    masked = lambda rows, by, names: rows.groupBy(*by).agg(*(F.coalesce(F.bit_or(F.when(F.col("slot") == i, F.col("bit"))), F.lit(0).cast("long")).alias(c) for i, c in enumerate(names)))
    wanted = questions.join(sent(vocabulary, small), "w")
    of_questions = tables.write(masked(wanted, ["q"], of_question), "questions")
    masks = tables.write(masked(postings, ids, of_doc), "masks")
    shared = lambda q: sum((F.bit_count(F.col(f"d{i}").bitwiseAND(q(f"q{i}"))) for i in slots), F.lit(0))
    met = postings.filter("slot is null").join(sent(wanted.filter("slot is null").select("q", "w"), small), "w").groupBy("q", *ids).agg(F.count(F.lit(1)).alias("n"))
    sums = met.join(masks, ids).join(sent(of_questions, n_questions <= SENT_QUESTIONS), "q").select("q", *ids, (F.col("n") + shared(F.col)).cast("int").alias("n"))
    best = lambda rows: top_hits(rows, ["q"], [F.desc("n"), *ids], k)
    first = tables.write(best(sums).drop("rank"), "first")
    least = first.groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("n")).otherwise(1).alias("least"))
    most = sum((F.bit_count(c) for c in of_question), F.lit(0))
    open_ = of_questions.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(1))).filter(most >= F.col("least"))
    groups = max(1, -(-n_questions // group))
    side = open_.groupBy(F.pmod(F.xxhash64("q"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("q", "least", *of_question)).alias("asked"))
    alike = F.row_number().over(Window.partitionBy(*of_doc).orderBy(*ids))
    spread = masks.withColumn("nth", alike).filter(F.col("nth") <= k).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    counted = F.transform("asked", lambda x: F.struct(x["q"].alias("q"), shared(lambda c: x[c]).alias("n"), x["least"].alias("least")))
    rest = spread.join(sent(side, n_questions <= SENT_QUESTIONS), "g").select(*ids, F.explode(F.filter(counted, lambda x: x["n"] >= x["least"])).alias("x")).select("x.q", *ids, "x.n")
    found = best(first.unionByName(rest).groupBy("q", *ids).agg(F.max("n").alias("n")))
    if ids != order:
        found = found.join(docs.select("__doc", *order), "__doc")
    return found.select("q.*", "rank", *order, "n")


def search_context(questions: DataFrame, hits: DataFrame, keys: list[str], otherwise: str = NO_CONTEXT) -> DataFrame:
    """Each question with ``context``: a line per hit (keys, rank, title, content) by rank; else, where ``hits`` has a column ``error`` with a value, that search's failure; else ``otherwise``."""
    told = hits if "error" in hits.columns else hits.withColumn("error", F.lit(None).cast("string"))
    line = F.when(F.col("error").isNull(), F.struct("rank", hit_line(F.col("title"), F.col("content")).alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    found = F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.concat(F.lit(FAILURE), F.max("error")))
    context = told.groupBy(*keys).agg(found.alias("context"))
    return questions.join(context, keys, "left").withColumn("context", F.coalesce("context", F.lit(otherwise)))
