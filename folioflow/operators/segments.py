"""From positioned lines to items: starts, page segments, and the tight range of lines in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import item_start, strip
from folioflow.operators.carry import carried

# Fixed values, in units of the page.
MARGIN, TOLERANCE, PADDING, LEAST_HEIGHT = 60.0, 4.0, 8.0, 2.0
#: Strips that a page is cut into for the join of segments and lines.
STRIPS = 32


def page_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, text, x0, y0, x1, y1) from spans (doc_id, page, block_type, block, line, span, text, x0, y0, x1, y1).

    Only text blocks (type 0) count; a line's box holds its spans' boxes; blank lines go.
    """
    per = spans.filter("block_type = 0").groupBy("doc_id", "page", "block", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "")
    made = per.agg(text.alias("text"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    return made.withColumn("text", strip(F.col("text"))).filter("text <> ''").drop("block", "line")


def in_reading_order(lines: DataFrame) -> DataFrame:
    """Lines by document, page, height and left edge."""
    return lines.orderBy("doc_id", "page", "y0", "x0")


def item_starts(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, qid, page, y) of the first line in reading order that begins with each of the ``expected`` (doc_id, qid) numbers."""
    found = lines.withColumn("qid", item_start(F.col("text"))).filter("qid is not null")
    found = found.join(expected.filter("qid <> ''").select("doc_id", "qid").distinct(), ["doc_id", "qid"], "left_semi")
    first = F.min(F.struct(F.col("page"), F.col("y0").alias("y"), F.col("x0"))).alias("at")
    return found.groupBy("doc_id", "qid").agg(first).select("doc_id", "qid", "at.page", "at.y")


def page_segments(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, qid, page, y0, y1): an item goes to the next start or the document's end, with a row for each page it touches.

    ``pages``: (doc_id, page, height). Segments of hardly any height go. The next start is carried over blocks of pages, so a long
    document's starts are spread.
    """
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    spread = carried(starts, ["doc_id"], "page", ("y", "qid"), nexts={"next": F.struct("page", "y")}).join(ends, "doc_id").withColumn("to", F.coalesce("next.page", "last_page"))
    each = spread.withColumn("at", F.explode(F.sequence("page", "to")))
    sized = each.join(pages.withColumnRenamed("page", "at"), ["doc_id", "at"])
    top = F.when(F.col("at") == F.col("page"), F.col("y")).otherwise(0.0)
    bottom = F.when(F.col("next").isNotNull() & (F.col("at") == F.col("next.page")), F.col("next.y")).otherwise(F.col("height").cast("double"))
    return sized.select("doc_id", "qid", F.col("at").alias("page"), top.alias("y0"), bottom.alias("y1")).filter(F.col("y1") > F.col("y0") + LEAST_HEIGHT)


def segment_texts(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, qid, n_pages, body): the texts (doc_id, page, text) of the pages that an item touches, in order."""
    met = segments.select("doc_id", "qid", "page").join(texts, ["doc_id", "page"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    return met.groupBy("doc_id", "qid").agg(F.count("*").alias("n_pages"), body.alias("body"))


def tight_segments(segments: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Segments drawn in to the lines that lie in them, headers and footers left out; without such lines they stay. Empty ones go.

    A line lies in one strip of its page, and a segment in all that it reaches into; they meet by page and strip, so a page with very
    many lines is spread. What lies above or below a page is in a strip of its own.
    """
    strip_of = lambda y: F.greatest(F.lit(-1), F.least(F.lit(STRIPS), F.coalesce(F.floor(y * STRIPS / F.nullif("height", F.lit(0))), F.lit(0)))).cast("int")
    keys = ["doc_id", "page"]
    side = lines.select(*keys, F.col("y0").alias("ly0"), F.col("y1").alias("ly1")).join(pages.select(*keys, "height"), keys)
    side = side.filter((F.col("ly1") >= MARGIN) & (F.col("ly0") <= F.col("height") - MARGIN)).select(*keys, strip_of(F.col("ly0")).alias("strip"), "ly0", "ly1")
    reach = F.sequence(strip_of(F.col("y0") - TOLERANCE), F.greatest(strip_of(F.col("y0") - TOLERANCE), strip_of(F.col("y1") + TOLERANCE)))
    laid = segments.select(*keys, "qid", "y0", "y1").join(pages.select(*keys, "height"), keys, "left").withColumn("strip", F.explode(reach)).drop("height")
    seg, lin = laid.alias("s"), side.alias("l")
    inside = (F.col("ly0") >= F.col("y0") - TOLERANCE) & (F.col("ly1") <= F.col("y1") + TOLERANCE)
    for k in (*keys, "strip"):
        inside = (F.col(f"s.{k}") == F.col(f"l.{k}")) & inside
    bound = seg.join(lin, inside, "left").groupBy(*(F.col(f"s.{k}") for k in keys), "qid", "y0", "y1").agg(F.min("ly0").alias("top"), F.max("ly1").alias("bottom"))
    y0 = F.coalesce(F.greatest("y0", F.col("top") - PADDING), F.col("y0"))
    y1 = F.coalesce(F.least("y1", F.col("bottom") + PADDING), F.col("y1"))
    return bound.select("doc_id", "qid", "page", y0.alias("y0"), y1.alias("y1")).filter("y1 > y0")
