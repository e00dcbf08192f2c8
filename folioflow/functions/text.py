"""Text functions as column expressions; all run inside the JVM.

Regular expressions carry ``(?U)`` where spaces and digits of any script count, ``(?d)`` where only a
line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Markdown markers that are removed, in order, and what stays of each.
MARKDOWN = (
    ("(?dUs)```.*?```", ""),
    (r"(?dU)\*\*+(.*?)\*\*+", "$1"),
    (r"(?dU)\*+(.*?)\*+", "$1"),
    (r"(?dU)__+(.*?)__+", "$1"),
    (r"(?dU)_+(.*?)_+", "$1"),
    (r"(?dUm)^#+\s+", ""),
    (r"(?dU)`(.*?)`", "$1"),
    (r"(?dU)\[(.*?)\]\(.*?\)", "$1"),
    (r"(?dUm)^[\s\t]*[\*\-\+]\s+", ""),
    (r"(?dUm)^[\s\t]*\d+\.\s+", ""),
)
#: What a text must hold for any of the rules to change it: a rule finds nothing without one of these. One class is tried at each character.
MARKER = r"(?U)[*_#`\[+\-\d](?:(?<=[*_#`\[])|(?<=[+-])\s|\.\s)"
#: ``(?U)\s``, character by character, and what else ``strip`` takes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"
# An item's number at the start of a line, the characters that no file name holds, those that are
# dropped from a choice, and a fenced block.
ITEM_START = r"(?U)^\s*(\d{1,3})\s*[.、．)]\s*"
UNSAFE = r'[\\/:*?"<>|]'
NO_LETTER = "[^A-Za-z ]"
FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
SOURCE_LIMIT, BUNDLE_LIMIT, SLOTS = 40_000, 120_000, 50
FAILURE = "failure: "
NO_CONTEXT, NO_ANSWER, NO_LINK, NO_REFERENCES, NO_REASON, NO_TITLE = "(no context)", "(no answer)", "(no link)", "(no references)", "(no reason given)", "document"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bare(text: Column, spaces: str) -> Column:
    """Without any of ``spaces`` at both ends."""
    return F.trim(text, F.lit(spaces))


def strip(text: Column) -> Column:
    """Without space of any script at both ends."""
    return bare(text, SPACES + SEPARATORS)


def strip_markdown(text: Column) -> Column:
    """Without Markdown's markers; null gives an empty text. A text without a marker is passed over by one search instead of ten."""
    whole = F.coalesce(text, F.lit(""))
    return strip(F.when(whole.rlike(MARKER), reduce(lambda c, rule: F.regexp_replace(c, *rule), MARKDOWN, whole)).otherwise(whole))


def choice_letters(text: Column) -> Column:
    """Upper-case ASCII letters and spaces of an answer; empty: no valid choice."""
    return F.trim(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), NO_LETTER, "")))


def extract_tag(text: Column, tag: str, otherwise: Column | None = None) -> Column:
    """Stripped inside of the first ``<tag>``; where there is none, ``otherwise`` (null by default)."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(F.lit(None).cast("string") if otherwise is None else otherwise)


def fenced_json(text: Column) -> Column:
    """Inside of the first fenced block, else the whole text; empty or null gives null."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(None)).when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def item_start(line: Column) -> Column:
    """An item's number at the start of a line, else null."""
    return F.nullif(F.regexp_extract(line, ITEM_START, 1), F.lit(""))


def base_id(qid: Column) -> Column:
    """The whole number before the first hyphen, else null."""
    return F.trim(F.split_part(qid, F.lit("-"), F.lit(1))).try_cast("int")


def truncated(text: Column, limit: int = SOURCE_LIMIT) -> Column:
    return F.substring(text, 1, limit)


def passes(review: Column) -> Column:
    """True where the review holds PASS in either case, anywhere; null is no pass."""
    return F.coalesce(F.contains(F.upper(review), F.lit("PASS")), F.lit(False))


def link_or(text: Column, otherwise: str = NO_LINK) -> Column:
    return F.when(F.startswith(text, F.lit("http")), text).otherwise(F.lit(otherwise))


def link_line(qid: Column, link: Column) -> Column:
    return F.concat(F.when(F.coalesce(qid, F.lit("")) == "", "?").otherwise(qid), F.lit(":"), link)


def path_stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def safe_name(name: Column, extension: str = ".docx") -> Column:
    return F.concat(F.regexp_replace(name, UNSAFE, "_"), F.lit(extension))


def reference_block(kind: Column, path: Column, content: Column) -> Column:
    return F.concat(F.lit("[reference] "), kind, F.lit(" / "), path, F.lit("\n"), content)


def hit_line(title: Column, content: Column) -> Column:
    return F.concat(F.lit("- "), F.coalesce(title, F.lit("None")), F.lit(": "), F.coalesce(content, F.lit("None")))


def filled(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; null values count as empty."""
    return reduce(lambda c, item: F.replace(c, F.lit("{" + item[0] + "}"), F.coalesce(item[1].cast("string"), F.lit(""))), values.items(), F.lit(template))


def as_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def image_parts(prompt: Column, images: Column, label: str = "image") -> Column:
    """Parts of a message: the prompt, then label and data URL for each of ``images`` (array of label, content) that has content."""
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("image_url"))
    nothing = F.lit(None).cast("string")
    shown = F.filter(F.coalesce(images, F.array().cast("array<struct<label:string,content:binary>>")), lambda x: x["content"].isNotNull())
    named = lambda x: F.when(F.trim(F.coalesce(x["label"], F.lit(""))) == "", F.lit(label)).otherwise(x["label"])
    each = F.flatten(F.transform(shown, lambda x: F.array(part("text", named(x), nothing), part("image_url", nothing, F.concat(F.lit("data:image/png;base64,"), F.base64(x["content"]))))))
    return F.concat(F.array(part("text", prompt, nothing)), each)
