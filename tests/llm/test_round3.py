"""Hard negatives, toxicity and fill-in-the-middle against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import infilling, negatives, toxicity

CLASHING = "lang string, n long, form string, output string, score string, part binary, dim int, block long, turn int"
SCHEMA = f"doc_id long, text string, {CLASHING}"
REST = ("x", 1, "x", "x", "x", b"x", 1, 1, 1)


# Fill-in-the-middle


def _infilled(doc_id, text):
    """The rule by a regular expression over tokens."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    told = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    return (len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infilling(spark):
    drawn = random.Random(4)
    texts = [None, "", " ", "a", "<P>", "x <M> y", "<<S>", "<", "word" * 50_000, "é𝄞漢字 mixed", "🙂" * 3000, "\n\n\r\t", "tail <P", "S> head"]
    texts += ["".join(drawn.choice("aZé𝄞 <>PSM\n.9") for _ in range(drawn.randint(1, 60))) for _ in range(600)]
    rows = [(i, t, *REST) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "no id", *REST), (3, "another text of 3", *REST), (-5, "below zero", *REST)]
    made = infilling.transform(spark.createDataFrame(rows, SCHEMA).repartition(3)).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made))) == sorted(map(repr, ((i, *_infilled(i, t), t or "") for i, t, *_ in rows)))
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert infilling.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boundaries_take_any_code_point():
    for text in ("", "ab", "a b", "[a]{z}@A`Z", "aéаb", "\x00a\U0010ffff"):
        assert infilling.boundaries(infilling.code_points(text)).tolist() == [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]


# Hard negatives


def _mined(rows, scale=256, every=50, k_positives=5, k=3):
    """All pairs, one by one. ``rows``: (id, vector, label) with the label as it is used."""
    whole = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, al in whole:
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(av, v, strict=True)), i, label) for i, v, label in whole if len(v) == len(av)), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == al and x[1] != a][:k_positives]:
            fit = [(-t, n) for t, n, label in scored if label != al and 50 * -s <= 100 * -t <= 95 * -s][:k]
            out += [(a, p, rank + 1, n, -s, t) for rank, (t, n) in enumerate(fit)]
    return sorted(out)


def _vectors(seed, n, dims, labels):
    drawn = np.random.Generator(np.random.PCG64(seed))
    return [(int(i), [float(np.float32(x)) for x in drawn.normal(0.2, 1, drawn.choice(dims))], int(drawn.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    """Several panels, shards and chunks, hot labels, ties, other lengths, unusable rows and repeated ones, against all pairs."""
    rows = _vectors(seed, 420, (17, 17, 17, 3), 3)
    rows += [(1000 + i, rows[7][1], 0) for i in range(120)]  # one vector many times
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 17, 1), (2150, [float("inf")] * 17, 1), (None, [1.0] * 17, 1), (2200, [1.0] * 17, None), (2250, [], 1), (2251, [], 1), (2252, [], 2)]
    rows += [rows[50], rows[51], rows[51]]
    df = spark.createDataFrame([(*r, "x", 1, 1, 1, b"x") for r in rows], "vec_id long, embedding array<float>, label int, text string, dim int, block long, turn long, part binary").repartition(5)
    got = negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label"), grid=negatives.Grid(4, 37, 5, 3, 2))
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == _mined(rows)
    assert len(_mined(rows)) > 100


def test_hard_negatives_of_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(50, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], [(50, [1.0], 1), (51, [1.0], 1)]):
        assert negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


@pytest.mark.parametrize("tile", [[], [0], [-1, 1], [127, -128], [32767, -32768, 5], [2**31, -(2**40)], [2**62, -(2**62)]])
def test_tiles_are_packed(tile):
    assert negatives.unpacked(negatives.packed(np.array(tile, np.int64))).tolist() == tile


# Toxicity


def _kinds(text, more=()):
    model = toxicity.Model(dict.fromkeys([*toxicity.INSULTS, *toxicity.THREATS, *more], 0.9))
    return [(text[a:b], kind) for a, b, kind, _ in toxicity.Reader(model).clauses(text)]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("You are an idiot. Fine.", ["aimed"]), ("what a MORON", ["insult"]), ("You are not an idiot", ["negated"]), ("You are not clever, idiot", ["aimed"]),
        ("He said you are stupid", ["reported"]), ("He said so. You are stupid", ["aimed"]), ("I will kill you", ["threat"]), ("I will kill time, you know", []),
        ("frost may kill them", []), ("never hurt you", ["negated"]), ("trash\ntrash; ok", ["insult", "insult"]), ("", []), ("harmless words, of you", []), ("idiotes", []),
        ("she isn't really a loser but you are a clown", ["aimed"]),
    ],
)
def test_clauses(text, kinds):
    assert [k for _, k in _kinds(text)] == kinds


def _walked(text, chances, weights):
    """The grammar by hand, over one clause's words."""
    seen, spared, open_, told, reach = set(), 1.0, False, False, 0
    for word in re.findall(r"[^\W\d_]+|,", text.lower()):
        insult, threat = word in chances and word not in toxicity.THREATS, word in chances and word in toxicity.THREATS
        left = max(reach - 1, 0)
        if insult or threat:
            weight = toxicity.NEGATED if open_ else toxicity.REPORTED if told else 1.0
            spared *= 1 - weight * chances[word]
            kind = "negated" if open_ else "reported" if told else "insult" if insult else None
            seen |= {kind} if kind else set()
            reach = toxicity.REACH if threat and not kind else left
            open_ = False
        elif word in toxicity.NEGATIONS:
            open_, reach = True, left
        elif word in toxicity.FILLERS:
            reach = left
        else:
            open_ = False
            told |= word in toxicity.REPORTS
            if word in toxicity.SECOND:
                seen |= {"target"} | ({"threat"} if reach else set())
                reach = 0
            else:
                seen |= {"target"} if word in toxicity.THIRD else set()
                reach = 0 if word == "," else left
    kind = "threat" if "threat" in seen else ("aimed" if "target" in seen else "insult") if "insult" in seen else "reported" if "reported" in seen else "negated" if "negated" in seen else None
    return (kind, (1 - spared) * weights[kind]) if kind else None


def test_composed_grammar_against_a_walk():
    drawn = random.Random(8)
    model = toxicity.Model({"idiot": 0.9, "trash": 0.6, "kill": 0.8})
    reader = toxicity.Reader(model)
    pool = ["idiot", "trash", "kill", "you", "they", "not", "a", "said", "word", ","]
    for _ in range(4000):
        text = " ".join(drawn.choice(pool) for _ in range(drawn.randint(1, 12)))
        want, got = _walked(text, model.chances, model.weights), reader.clauses(text)
        assert (want is None) == (not got), text
        if want:
            assert got[0][2] == want[0] and abs(got[0][3] - want[1]) < 1e-12, text


def test_only_words_without_another_reason_are_blamed():
    """Word 0 explains most, 1 stands beside it and elsewhere, 2 alone explains others, 3 stands in clean texts as well."""
    docs = [(d, w) for d in range(40) for w in (0, 1)] + [(d, 2) for d in range(40, 60)] + [(d, 3) for d in range(20)]
    d, w = (np.array(x) for x in zip(*docs, strict=True))
    p, leak = toxicity.noisy_or(d, w, np.array([40.0, 60, 20, 400]), np.array([True, False, False, False]), 1000)
    assert p[0] > 0.8 and p[2] > 0.8 and max(p[1], p[3]) < 0.1 and leak < 0.05


def _corpus(n=1500):
    drawn = random.Random(2)
    own = ["grumbel", "snorfit"]
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [drawn.choice(words) for _ in range(drawn.randint(30, 80))]
        if toxic := i % 6 == 0:
            for _ in range(2):
                text.insert(drawn.randrange(len(text)), drawn.choice(own if i % 4 else ["moron"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows, own


def test_held_out_toxic_texts(spark):
    rows, own = _corpus()
    docs = spark.createDataFrame([(i, t, *REST) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs.select("doc_id", "text"), labels)
    assert set(own) <= set(model.chances) and len(model.chances) <= len(toxicity.INSULTS) + len(toxicity.THREATS) + len(own) + 2
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(got[i].predicted == x for i, _, x in rows if got[i].held_out) >= 0.99 * sum(r.held_out for r in got.values())
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.trained(docs.select("doc_id", "text"), other) == model  # held-out labels teach nothing


def test_toxicity_edges(spark):
    texts = [None, "", "x" * 100_000, "you idiot " * 20_000, "fine words", "you idiot"]
    docs = spark.createDataFrame([(i, t, *REST) for i, t in enumerate(texts)] + [(5, "you idiot", *REST), (None, "moron", *REST)], SCHEMA)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (empty, spark.createDataFrame([(None, 1), (1, None)], empty.schema), spark.createDataFrame([(4, 1), (5, 1)], empty.schema)):
        got = toxicity.score(docs, labels).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert [r.predicted for r in got if r.doc_id in (0, 1, 2, 4)] == [0] * 4 and all(r.predicted for r in got if r.doc_id in (3, 5, None))
        assert not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.score(docs.limit(0), empty).count() == 0
