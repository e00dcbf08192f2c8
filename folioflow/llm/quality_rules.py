"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, documents get a posterior.

Counts per document are array expressions inside one row, so no text is shuffled. EM needs only
how often each pattern of votes occurs (at most 3 ** rules rows, whatever the corpus), and one row
of sums per round. No Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import UPPER, Scratch, fresh, space_words, table

#: For each rule: counted against, bad from this ratio, good below this ratio (abstains between).
RATIO_RULES = (
    ("symbols", "n_symbols", "n_words", 0.15, 0.05),
    ("marks", "n_marks", "n_words", 0.5, 0.1),
    ("decorated", "n_decorated", "n_words", 0.2, 0.05),
    ("capitals", "n_capitals", "word_chars", 0.5, 0.2),
    ("dup_lines", "n_dup_lines", "n_lines", 0.4, 0.15),
    ("repeats", "n_repeat_words", "n_words", 0.4, 0.2),
)
RULES = (*(r[0] for r in RATIO_RULES), "word_length", "length")
PRIOR, ROUNDS, SETTLED = 0.8, 15, 1e-3
#: How a rule votes (good, abstains, bad) on good and on bad documents, as believed before any document.
ON_GOOD, ON_BAD = (0.8, 0.18, 0.02), (0.5, 0.2, 0.3)
#: The belief counts as much as so many documents of each class, or this share of all, whichever is more.
BELIEF, BELIEF_SHARE = 20.0, 0.05
LEAST, MOST = 0.5, 0.95
KEEP_FROM = 0.5


@dataclass(frozen=True)
class Model:
    """``prior``: share of good documents; for each rule how it votes (good, abstains, bad) on good and on bad ones."""

    prior: float
    accuracies: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def weights(self) -> list[tuple[float, float, float]]:
        """For each rule what its vote adds to the log odds: a vote for good never counts against, nor one for bad in favour."""
        found = []
        for good, bad in self.accuracies:
            up, none, down = (math.log(g / b) for g, b in zip(good, bad, strict=True))
            found.append((max(0.0, up), none, min(0.0, down)))
        return found


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that stand twice or more in the text, the first included.

    Windows are sorted by hash with their places; those whose hash another one has are sorted again by their
    words, so equal hashes alone don't count. Each place that is left covers the words up to the next one,
    three at most. A text without two equal hashes ends early.
    """
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def twice(ranked: Column) -> Column:
        equal = lambda x, j: (F.get(ranked, j - 1)["w"] == x["w"]) | (F.get(ranked, j + 1)["w"] == x["w"])
        return F.filter(ranked, lambda x, j: F.coalesce(equal(x, j), F.lit(False)))

    def covered(each: Column) -> Column:
        hashed = let(F.sort_array(F.transform(each, lambda h, i: F.struct(h.alias("w"), i.alias("i")))), twice)
        spelled = let(F.sort_array(F.transform(hashed, lambda x: F.struct(F.slice(words, x["i"] + 1, F.lit(3)).alias("w"), x["i"].alias("i")))), twice)
        places = F.sort_array(F.transform(spelled, lambda x: x["i"]))
        total = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")))["n"]
        return F.when(F.size(F.array_distinct(each)) == F.size(each), F.lit(0).cast("long")).otherwise(total)

    return let(windows, covered)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counts(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """The expressions of all counts over a column of words, by name, in order; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    without = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    return {
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": without("#*$%&|<>"),
        "n_marks": without("!?|{}~^_="),
        "n_decorated": F.regexp_count(text, F.lit(r"[#*$%&!?|~^_=<>{}]{2,}")).cast("long"),
        "n_capitals": without(UPPER),
        "lines": lines,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_decorated", "n_capitals", "lines.n_lines", "lines.n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and a struct ``name`` of the counts of each row's whole text; ``COUNTS`` tells its fields."""
    (words,) = fresh(docs, "words")
    c = counts(docs, text_col)
    made = F.struct(
        F.size(words).cast("long").alias("n_words"), *(c[n].alias(n) for n in ("word_chars", "n_symbols", "n_marks", "n_decorated", "n_capitals")),
        let(c["lines"], lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        repeat_words(F.col(words)).alias("n_repeat_words"),
    )
    return docs.withColumn(words, space_words(F.col(text_col))).select(*(F.col(f"`{x}`") for x in docs.columns), made.alias(name))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and counts of the method's own."""
    (name,) = fresh(docs, "counts")
    keep = [F.col(f"`{x}`") for x in docs.columns if x != text_col]
    # The one-row generator keeps filters on the counts above it; pushed below, each mention of a count would compute it anew.
    held = with_counts(docs, name, text_col).select(*keep, F.explode(F.array(name)).alias(name))
    return held.select(*keep, *(f"{name}.{x}" for x in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> list[Column]:
    """1 good, -1 bad, 0 abstains, in the order of ``RULES``."""
    found = []
    for _, part, whole, bad, good in RATIO_RULES:
        ratio = F.col(part) / F.greatest(F.col(whole), F.lit(1))
        found.append(F.when(ratio >= bad, -1).when(ratio < good, 1).otherwise(0))
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    found.append(F.when((mean < 2.5) | (mean > 14), -1).when((mean >= 3) & (mean <= 11), 1).otherwise(0))
    found.append(F.when(F.col("n_words") < 20, -1).when(F.col("n_words") >= 100, 1).otherwise(0))
    return found


def posterior(model: Model, cast_votes: list[Column]) -> Column:
    """Probability that a document with these votes is good."""
    score = F.lit(math.log(model.prior / (1 - model.prior)))
    for vote, (up, none, down) in zip(cast_votes, model.weights(), strict=True):
        score = score + F.when(vote == 1, F.lit(up)).when(vote == -1, F.lit(down)).otherwise(F.lit(none))
    return 1 / (1 + F.exp(-score))


def fit(features: DataFrame, rounds: int = ROUNDS) -> Model:
    """EM over the patterns of votes of all rows of ``features`` (the output of ``measured``).

    Rows that fail the base rules are left out: they go anyway, and would fill the class of bad documents
    with short ones. No rows: the model of before. ``BELIEF`` keeps rules that seldom vote near what is believed of them.
    """
    names = [f"v{i}" for i in range(len(RULES))]
    counted = features.filter(~base_failed()).select(*(v.alias(n) for v, n in zip(votes(), names, strict=True))).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    with Scratch(features.sparkSession, "quality") as scratch:
        return _fitted(scratch.cut(counted.coalesce(1), "vote-patterns"), names, rounds)


def _fitted(patterns: DataFrame, names: list[str], rounds: int) -> Model:
    model = Model(PRIOR, ((ON_GOOD, ON_BAD),) * len(RULES))
    for _ in range(rounds):
        p = patterns.withColumn("p", posterior(model, [F.col(n) for n in names]))
        part = lambda v, value, share: F.sum(F.when(F.col(v) == value, F.col("n") * share).otherwise(0.0))
        sums = [part(v, value, share) for v in names for share in (F.col("p"), 1 - F.col("p")) for value in (1, 0, -1)]
        total, good, *rest = p.agg(F.sum("n"), F.sum(F.col("n") * F.col("p")), *sums).first()
        if not total:
            return model
        belief = max(BELIEF, BELIEF_SHARE * total)
        accuracies = []
        for i in range(len(names)):
            both = []
            for k, believed in enumerate((ON_GOOD, ON_BAD)):
                seen = rest[6 * i + 3 * k : 6 * i + 3 * k + 3]
                both.append(tuple(round((x + belief * b) / (sum(seen) + belief), 9) for x, b in zip(seen, believed, strict=True)))
            accuracies.append(tuple(both))
        after = Model(round(min(MOST, max(LEAST, good / total)), 9), tuple(accuracies))
        flat = lambda m: [m.prior, *(x for rule in m.accuracies for side in rule for x in side)]
        moved = max(abs(x - y) for x, y in zip(flat(model), flat(after), strict=True))
        model = after
        if moved < SETTLED:
            break
    return model


def judged(features: DataFrame, model: Model) -> DataFrame:
    """Adds ``base_failed``, ``quality`` (the posterior) and ``kept``."""
    return features.withColumn("base_failed", base_failed()).withColumn("quality", posterior(model, votes())).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged. Null and empty texts go; repeated rows are judged alike and stay repeated.

    Each text is measured once: rows are written with their counts, the model is fitted on the counts alone,
    and the result is a filter on what was written. A posterior of exactly ``KEEP_FROM`` keeps. Texts of any
    length are measured whole. An empty table gives an empty table.
    """
    row, counted = fresh(docs, "row", "counts")
    scratch = Scratch(docs.sparkSession, "quality")
    held = scratch.cut(with_counts(docs, counted, text_col), "measured", keep=True)
    fields = [f"{counted}.{x}" for x in COUNTS]
    model = fit(held.select(*fields))
    return judged(held.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), *fields), model).filter("kept").select(f"{row}.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    features = scratch.cut(measured(table(spark, sf_dir, "documents").select("doc_id", "text")), "counts", keep=True)
    return judged(features, fit(features)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
