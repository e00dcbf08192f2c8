"""Markdown tables inside a text: lines, cells, blocks, and paragraphs between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import SPACES, let, strip, strip_markdown

BREAKS = "[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLOCKS = "array<struct<kind:string,text:string,cells:array<array<string>>>>"
#: A table's lines, or any other line; each line begins with its mark: (s)eparator with bars, (b)ars, (r)ule without bars, (n)either.
PARTS = r"[bs][^\n]*+\n[rs][^\n]*+(?:\n[bs][^\n]*+)*+|[^\n]++"


def lines(text: Column) -> Column:
    """Lines without their ends and without space at the right; an empty text has none."""
    split = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), BREAKS)
    whole = let(split, lambda s: F.when(F.element_at(s, -1) == "", F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s))
    return F.transform(whole, lambda x: F.rtrim(x, F.lit(SPACES)))


def is_table_line(line: Column) -> Column:
    return F.contains(line, F.lit("|")) & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)


def cells(line: Column) -> Column:
    """Cells without space around them; one bar at each end is left out."""
    bar = F.lit("|")
    left = let(strip(line), lambda b: F.when(F.startswith(b, bar), F.substr(b, F.lit(2))).otherwise(b))
    inner = let(left, lambda b: F.when(F.endswith(b, bar), F.substr(b, F.lit(1), F.length(b) - 1)).otherwise(b))
    return F.transform(F.split(inner, r"\|"), strip)


def is_separator(line: Column) -> Column:
    return F.contains(line, F.lit("---")) & F.forall(cells(line), lambda c: c.rlike("^:?-{3,}:?$"))


def blocks(text: Column) -> Column:
    """Array of paragraphs (``text``) and tables (``cells``) in order.

    A table begins at a table line before a separator line and goes on while lines are table lines; it takes
    its lines, so none can begin within it. Separators and blank rows inside it go, short rows are filled up,
    cells lose their Markdown. Other lines become paragraphs, one for each that isn't blank without its Markdown.
    One pattern over the marked lines finds the parts, so the work grows with the text's length.
    """
    letter = lambda x: F.when(is_table_line(x), F.when(is_separator(x), "s").otherwise("b")).otherwise(F.when(is_separator(x), "r").otherwise("n"))
    marked = lambda t: F.array_join(F.transform(lines(t), lambda x: F.concat(letter(x), x)), "\n")

    def table(part: Column) -> Column:
        kept = F.filter(F.split(part, "\n"), lambda x: ~F.substring(x, 1, 1).isin("s", "r"))
        rows = F.filter(F.transform(kept, lambda x: cells(F.substr(x, F.lit(2)))), lambda c: F.exists(c, lambda v: v != ""))
        filled = lambda rows, width: F.transform(rows, lambda c: F.transform(F.concat(c, F.array_repeat(F.lit(""), width - F.size(c))), strip_markdown))
        return let(rows, lambda held: let(F.array_max(F.transform(held, F.size)), lambda width: filled(held, width)))

    def block(part: Column) -> Column:
        many = F.contains(part, F.lit("\n"))
        return F.struct(
            F.when(many, "table").otherwise("paragraph").alias("kind"),
            F.when(~many, strip_markdown(F.substr(part, F.lit(2)))).otherwise(F.lit(None).cast("string")).alias("text"),
            F.when(many, table(part)).otherwise(F.lit(None).cast("array<array<string>>")).alias("cells"),
        )

    made = lambda t: F.filter(F.transform(F.regexp_extract_all(marked(t), F.lit(PARTS), F.lit(0)), block), lambda b: (F.coalesce(b["text"], F.lit("")) != "") | b["cells"].isNotNull())
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(F.length(t) == 0, F.array().cast(BLOCKS)).otherwise(made(t)))
