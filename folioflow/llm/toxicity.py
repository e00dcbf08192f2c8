"""Toxicity by a weighted finite-state grammar of clauses.

1. Words become symbols: insult, threat, target (second or third person), negation, filler, reporting verb, other, and soft borders.
   Clauses end at sentence marks and line ends.
2. Three weighted transducers are composed once: one turns insults and threats under a negation into negated ones,
   one turns those that a reporting verb introduces into reported ones, and the last joins insults and threats with targets
   and ends in the clause's kind. Weights multiply along a path.
3. A clause's evidence is the chance that one of its insults is meant as such, times the weight of its kind; a document's
   score is the chance that one of its clauses is toxic. A word alone is scored as the clause that it stands in.
4. Words that insult are told by a short list and learned from labelled rows by a noisy-or: of the words of a toxic text those
   that other texts don't explain share the blame, so words that merely stand beside an insult get none. Weights
   of kinds come from the same rows, drawn to their priors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, table

#: Labelled rows of either kind that are learned from (``TOXIC`` and ``CLEAN``), those with the smallest hashes, and the most words that may be learned.
TOXIC, CLEAN, VOCABULARY = 8_000, 12_000, 4_096
#: A learned word stands in so many toxic texts at least (near copies count once) and so many times as often as in clean ones.
SUPPORT, LIFT = 4, 5.0
#: A word that is blamed less often isn't an insult. Rows of prior belief in listed and in other words, and their means.
LEAST = 0.4
LISTED, LISTED_CHANCE, OTHER, OTHER_CHANCE = 4.0, 0.9, 1.0, 0.1
LEAK, STEPS = 0.02, 300
PREDICT_FROM, HELD_OUT = 0.5, 0
#: What is left of an insult that is negated, or told of another's speech.
NEGATED, REPORTED = 0.1, 0.4
#: Kinds of clauses, the strongest first, with the prior of their weight, and rows of belief in it.
KINDS = {"threat": 0.7, "aimed": 0.97, "insult": 0.9, "reported": 0.5, "negated": 0.5}
BELIEF = 10.0
#: Words between a threat and its target at most.
REACH = 3

INSULTS = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles cretin cretins stupid dumb dumbass loser losers scum scumbag scumbags trash garbage vermin filth filthy worthless pathetic "
    "disgusting disgrace clown clowns pig pigs rat rats freak freaks creep creeps jerk jerks asshole assholes bastard bastards bitch bitches coward cowards parasite parasites retard retards retarded "
    "idiota idiotas imbécil imbéciles estúpido estúpida tonto basura escoria cabrón crétin crétins connard connards salaud débile ordure stupide idiote idioten trottel arschloch abschaum dummkopf depp dreckskerl"
).split()
THREATS = "kill murder strangle stab shoot hang butcher slaughter hurt destroy beat burn crush".split()
SECOND = "you your yours yourself yourselves u ur ya tú usted ustedes vosotros toi vous dich euch".split()
THIRD = "he she him her they them their those these who ellos ellas ils elles".split()
NEGATIONS = "not no never isn aren wasn weren ain hardly nobody nicht kein keine keinen pas jamais nunca".split()
FILLERS = "a an the t re s so such very really that at all some ein eine einen un une una des".split()
REPORTS = "said says say saying wrote writes called calls calling quoted quotes claimed claims alleged reported shouted yelled dijo llamó écrit appelé sagte nannte schrieb".split()

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"([^\W\d_]+)|([.!?;:…。！？]|[\r\n]+)|(,)")
SCORED = "doc_id long, score double, clauses array<struct<start:int,end:int,kind:string,weight:double>>"
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())])))])

# i insult, t threat, y second person, z third person, n negation, d filler, r report, x other, "," soft border;
# what the transducers make of them: j negated insult, u negated threat, k reported insult, v reported threat.
SYMBOLS = "itynzdrx,"


@dataclass
class Transducer:
    """Deterministic in its input: ``arcs[state][symbol]`` is (output, weight, next state); ``ends[state]`` is what a path that stops there is worth."""

    start: object
    arcs: dict = field(default_factory=dict)
    ends: dict = field(default_factory=dict)


def composed(first: Transducer, second: Transducer) -> Transducer:
    """What ``first`` writes, ``second`` reads; weights multiply. Only states that can be reached are made."""
    start = (first.start, second.start)
    made, todo = Transducer(start), [start]
    while todo:
        state = todo.pop()
        if state in made.arcs:
            continue
        a, b = state
        made.ends[state] = second.ends.get(b)
        made.arcs[state] = {}
        for symbol, (out, weight, to) in first.arcs[a].items():
            last, more, then = second.arcs[b][out]
            made.arcs[state][symbol] = last, weight * more, (to, then)
            todo.append((to, then))
    return made


def negation() -> Transducer:
    """A negation reaches over fillers to the insult or threat that follows it, and no further."""
    arcs = {open_: {s: (s, 1.0, False) for s in SYMBOLS} for open_ in (False, True)}
    for open_ in arcs:
        arcs[open_]["n"] = "x", 1.0, True
    arcs[True] |= {"d": ("d", 1.0, True), "i": ("j", NEGATED, False), "t": ("u", NEGATED, False)}
    return Transducer(False, arcs, {False: None, True: None})


def reporting() -> Transducer:
    """After a reporting verb the rest of the clause is another's speech."""
    arcs = {told: {s: (s, 1.0, told) for s in SYMBOLS + "ju"} for told in (False, True)}
    arcs[False]["r"] = "x", 1.0, True
    arcs[True] |= {"r": ("x", 1.0, True), "i": ("k", REPORTED, True), "t": ("v", REPORTED, True), "j": ("j", 1.0, True), "u": ("u", 1.0, True)}
    return Transducer(False, arcs, {False: None, True: None})


def aiming() -> Transducer:
    """Joins insults and threats with targets: a state tells what was seen, and how many words a threat still reaches."""
    found = Transducer((frozenset(), 0))
    todo = [found.start]
    while todo:
        state = todo.pop()
        if state in found.arcs:
            continue
        seen, reach = state
        left = max(reach - 1, 0)
        arcs = {s: (s, 1.0, (seen, left)) for s in "xndr"}
        arcs[","] = ",", 1.0, (seen, 0)
        arcs["i"] = "i", 1.0, (seen | {"insult"}, left)
        arcs["t"] = "t", 1.0, (seen, REACH)
        arcs["y"] = "y", 1.0, (seen | {"target"} | ({"threat"} if reach else set()), 0)
        arcs["z"] = "z", 1.0, (seen | {"target"}, left)
        arcs |= {s: (s, 1.0, (seen | {kind}, left)) for s, kind in (("j", "negated"), ("u", "negated"), ("k", "reported"), ("v", "reported"))}
        found.arcs[state] = arcs
        found.ends[state] = "threat" if "threat" in seen else ("aimed" if "target" in seen else "insult") if "insult" in seen else next((k for k in ("reported", "negated") if k in seen), None)
        todo += [to for _, _, to in arcs.values()]
    return found


GRAMMAR = composed(composed(negation(), reporting()), aiming())


@dataclass
class Model:
    """Chances of words, weights of kinds, and the score of a text without a clause that matches."""

    chances: dict[str, float]
    weights: dict[str, float] = field(default_factory=lambda: dict(KINDS))
    leak: float = LEAK

    def symbols(self) -> dict[str, str]:
        told = {w: s for s, words in (("d", FILLERS), ("z", THIRD), ("y", SECOND), ("r", REPORTS), ("n", NEGATIONS)) for w in words}
        return told | {w: "t" if w in THREATS else "i" for w in self.chances}


class Reader:
    """Clauses of texts; numbers of the grammar's states stand for the states."""

    def __init__(self, model: Model):
        self.model, self.symbols, self.words = model, model.symbols(), frozenset(model.chances)
        number = {s: i for i, s in enumerate(GRAMMAR.arcs)}
        self.start = number[GRAMMAR.start]
        self.arcs = [{s: (w, number[to]) for s, (_, w, to) in GRAMMAR.arcs[state].items()} for state in number]
        self.ends = [GRAMMAR.ends[state] for state in number]

    def clauses(self, text: str) -> list[tuple[int, int, str, float]]:
        """Start, end, kind and weight of each clause that the grammar accepts."""
        if self.words.isdisjoint(_WORD.findall(text.lower())):
            return []
        found, state, begin, end, spared = [], self.start, None, 0, 1.0

        def close():
            if spared < 1 and (kind := self.ends[state]):
                found.append((begin, end, kind, (1 - spared) * self.model.weights[kind]))

        for m in _TOKEN.finditer(text):
            if m[2]:
                close()
                state, begin, spared = self.start, None, 1.0
                continue
            word = m[1].lower() if m[1] else ","
            symbol = self.symbols.get(word, "x") if m[1] else ","
            weight, state = self.arcs[state][symbol]
            if symbol in "it":
                spared *= 1 - weight * self.model.chances[word]
            begin, end = m.start() if begin is None else begin, m.end()
        close()
        return found

    def score(self, clauses: list[tuple[int, int, str, float]]) -> float:
        clean = 1 - self.model.leak
        for *_, weight in clauses:
            clean *= 1 - weight
        return 1 - clean


def look(words: list[str]) -> int:
    """A number that near copies mostly share: the least hash of three words in a row."""
    held = {w: zlib.crc32(w.encode()) for w in words}
    x = np.fromiter((held[w] for w in words), np.uint64, len(words))
    if len(x) > 2:
        x = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((x ^ (x >> np.uint64(32))).min(initial=2**63 - 1) >> np.uint64(1))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 5 is ``HELD_OUT``; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """``toxic``, ``text``, ``look`` and the distinct ``words`` of at most ``toxic`` + ``clean`` labelled rows outside the held-out part.

    Null labels and ids teach nothing; of an id labelled twice the higher label holds.
    """
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    first = lambda kind, n: told.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, toxic).unionByName(first(0, clean))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            all_words = [_WORD.findall((t or "").lower()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([look(w) for w in all_words]), pa.array([sorted(set(w)) for w in all_words], pa.list_(pa.string()))], ["toxic", "text", "look", "words"])

    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return joined.select("toxic", "text").mapInArrow(run, "toxic int, text string, look long, words array<string>")


def noisy_or(docs: np.ndarray, words: np.ndarray, shown: np.ndarray, listed: np.ndarray, texts: int, leak: float = LEAK) -> tuple[np.ndarray, float]:
    """Chance of each word, and the leak, by expectation-maximisation.

    ``docs`` and ``words``: (toxic text, word) as numbers, each pair once; ``shown``: texts that hold each word, clean ones included;
    ``listed``: which words the list has; ``texts``: all texts.
    """
    rows, mean = np.where(listed, LISTED, OTHER), np.where(listed, LISTED_CHANCE, OTHER_CHANCE)
    p, n_toxic = np.where(listed, LISTED_CHANCE, 0.5), docs.max(initial=-1) + 1
    for _ in range(STEPS):
        clean = np.full(n_toxic, np.log1p(-leak))
        np.add.at(clean, docs, np.log1p(-np.minimum(p[words], 1 - 1e-9)))
        toxic = -np.expm1(clean)
        blame = np.bincount(words, p[words] / toxic[docs], minlength=len(p))
        p = (blame + rows * mean) / (shown + rows)
        leak = float((np.sum(leak / toxic) + 1) / (texts + 1 / LEAK))
    return p, leak


def learned(rows: DataFrame) -> Model:
    """The model of labelled ``rows`` (as ``sample`` gives them). Without labels it is the list with its priors."""
    near = rows.groupBy("toxic", "look").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    n = {r.toxic: r["count"] for r in near.groupBy("toxic").count().collect()}
    each = near.select("toxic", "look", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("support"), F.count_if(F.col("toxic") == 0).alias("clean"))
    listed = [*INSULTS, *THREATS]
    often = (F.col("support") >= SUPPORT) & (F.col("support") * float(n.get(0, 0) + 1) >= LIFT * (n.get(1, 0) + 1) * (F.col("clean") + 1))
    grammar = [*SECOND, *THIRD, *NEGATIONS, *FILLERS, *REPORTS]
    found = counts.filter((often & ~F.col("word").isin(grammar)) | F.col("word").isin(listed)).orderBy(F.desc(F.col("word").isin(listed)), F.desc("support"), "word").limit(VOCABULARY).collect()
    known = set(listed)
    model = Model(dict.fromkeys(listed, LISTED_CHANCE))
    if not found:
        return model
    at = {r.word: i for i, r in enumerate(found)}
    words = F.broadcast(rows.sparkSession.createDataFrame([(w,) for w in at], "word string"))
    held = each.filter("toxic = 1").join(words, "word").groupBy("look").agg(F.collect_set("word").alias("words")).orderBy("look").collect()  # ``TOXIC`` rows at most
    docs, of = (np.array(x, np.int64) for x in ([i for i, r in enumerate(held) for _ in r.words], [at[w] for r in held for w in r.words]))
    support, clean, own = np.array([r.support for r in found], float), np.array([r.clean for r in found], float), np.array([r.word in known for r in found])
    p, leak = noisy_or(docs, of, support + clean, own, sum(n.values()))
    share = (support + np.where(own, LISTED * LISTED_CHANCE, OTHER * OTHER_CHANCE)) / (support + clean + np.where(own, LISTED, OTHER))
    alone = n.get(1, 0) - len(held)  # toxic texts without any of the words
    model.leak = min(0.3, max(leak, (alone + 1) / (sum(n.values()) + 1 / LEAK)))
    model.chances |= {r.word: float(x) for r, x in zip(found, share, strict=True)}
    model.chances = {w: x for w, x in model.chances.items() if w not in at or p[at[w]] >= LEAST}
    return model


def weighed(rows: DataFrame, model: Model) -> Model:
    """``model`` with the weights of kinds that labelled ``rows`` give: how often texts are toxic whose strongest clause is of a kind."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        reader, order = Reader(sent.value), list(KINDS)
        for batch in batches:
            kinds = [min((k for _, _, k, _ in reader.clauses(t or "")), key=order.index, default=None) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string())], ["toxic", "look", "kind"])

    counted = rows.select("toxic", "look", "text").mapInArrow(run, "toxic int, look long, kind string").filter("kind is not null").distinct().groupBy("kind").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    for r in counted.collect():  # one row for each kind
        model.weights[r.kind] = (r.toxic + BELIEF * KINDS[r.kind]) / (r.n + BELIEF)
    return model


def trained(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        rows = scratch.cut(sample(docs, labels, toxic, clean), "sample")
        return weighed(rows, learned(rows))


def matched(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SCORED``: each row's score and its clauses that match, in code points with the end exclusive.

    Null and empty texts have no clause and the score of such texts (``Model.leak``). A text is read whole, in time linear in it; one without an
    end of a sentence is one clause. Repeated rows have equal scores; other columns aren't read; no rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        reader = Reader(sent.value)
        for batch in batches:
            found = [reader.clauses(t or "") for t in batch.column(1).to_pylist()]
            clauses = [[dict(zip(("start", "end", "kind", "weight"), c, strict=True)) for c in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader.score(x) for x in found], pa.float64()), pa.array(clauses, _SCORED.field(2).type)], schema=_SCORED)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``clauses`` per row of ``docs``; see ``matched`` and ``sample`` for the edges."""
    docs = docs.select("doc_id", "text")
    scored = matched(docs, trained(docs, labels.select("doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"), "clauses")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("clauses").alias("n_clauses"))
