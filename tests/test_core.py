import json
import random
import re
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

from folioflow.functions import markdown as M
from folioflow.functions import text as X
from folioflow.operators import answers as A
from folioflow.operators import references as R
from folioflow.operators import results as P
from folioflow.operators import segments as S
from folioflow.operators.images import merge_down
from folioflow.plans import catalogue
from folioflow.plans.documents import cached, stage_key, with_feedback
from folioflow.plans.rounds import solve, vector_of
from folioflow.sources.providers import arithmetic, use_tool

SF = "/root/testdata/sf0.001"


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (X.strip_markdown, "snake_case_name and a*b*c", "snakecasename and abc"),
        (X.strip_markdown, "#\n\nfoo", "foo"),
        (X.strip_markdown, "3.14 is pi", "3.14 is pi"),
        (X.strip_markdown, None, ""),
        (X.strip_markdown, "```x\ny```\nafter", "after"),
        (X.choice_letters, "答案：a, b", "A B"),
        (X.choice_letters, "（一）", ""),
        (X.item_start, "１. a", "１"),
        (X.item_start, "1234. x", None),
        (X.item_start, "3.14 x", "3"),
        (X.item_start, "　1、a", "1"),
        (X.passes, "not pass", True),
        (X.passes, None, False),
        (X.base_id, "3-1", 3),
        (X.base_id, "x", None),
        (X.base_id, "-2", None),
        (X.path_stem, "file:/a/b.c/d.e.pdf", "d.e"),
        (X.safe_name, 'a/b:c', "a_b_c.docx"),
        (M.cells, "|a||", ["a", ""]),
        (M.cells, "||", [""]),
        (M.is_separator, "---", True),
        (M.is_separator, "|---|:--:|", False),
    ],
)
def test_functions(spark, function, value, expected):
    assert one(spark, value, function) == expected


def test_blocks(spark):
    got = one(spark, "p\n| a | b |\n|---|---|\n| **1** |\n|---|---|\n|  | |\n\nq", M.blocks)
    assert [(b.kind, b.text, b.cells) for b in got] == [("paragraph", "p", None), ("table", None, [["a", "b"], ["1", ""]]), ("paragraph", "q", None)]
    assert one(spark, "", M.blocks) == []


def _blocks(text):
    """``M.blocks`` line by line."""
    inner = lambda x: [c.strip() for c in re.sub(r"\|$", "", re.sub(r"^\|", "", x.strip())).split("|")]
    rule = lambda x: all(re.fullmatch(":?-{3,}:?", c) for c in inner(x))
    bar = lambda x: x.strip().count("|") >= 2
    held, out, i = text.split("\n"), [], 0
    while i < len(held):
        if bar(held[i]) and i + 1 < len(held) and rule(held[i + 1]):
            j = i + 2
            while j < len(held) and bar(held[j]):
                j += 1
            rows = [c for c in (inner(x) for x in held[i:j] if not rule(x)) if any(c)]
            width = max(map(len, rows), default=0)
            out.append(("table", None, [c + [""] * (width - len(c)) for c in rows]))
            i = j
        else:
            out += [("paragraph", held[i].strip(), None)] if held[i].strip() else []
            i += 1
    return out


def test_blocks_of_whole_texts(spark):
    """Ragged tables, rules, blank lines and long texts, against a loop; a quadratic fold doesn't end within the limit."""
    drawn = random.Random(3)
    kinds = ["| a | b |", "a|b|c|d", "|---|---|", "---", "| --- |", "", "  ", "word", "| | |", "||", "|:---:|", "x | y"]
    texts = ["\n".join(drawn.choice(kinds) for _ in range(drawn.randint(1, 60))) for _ in range(300)]
    texts += ["\n".join(["p | q"] * 6000 + ["| h |", "|---|"] + [f"| {i} |" + " x |" * (i % 5) for i in range(6000)] + ["end"])]
    began = time.time()
    got = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", M.blocks(F.col("c")).alias("b")).collect()
    assert time.time() - began < 60
    assert all([(b.kind, b.text, b.cells) for b in r.b] == _blocks(texts[r.i]) for r in got) and len(got) == len(texts)


def test_a_text_is_worked_out_and_split_once(spark):
    """The block scan names its text and its lines once; each mention is work again on the whole text. Space is trimmed as the patterns would."""
    whole = spark.createDataFrame([("a",)], "c string").select(F.posexplode(M.blocks(F.concat("c", F.lit("mark")))))
    told = whole._jdf.queryExecution().analyzed().toString()
    assert told.count("mark") == 1 and told.count(M.BREAKS) == 1
    texts = [(chr(c) + "a" + chr(c) + "b" + chr(c) * 2,) for c in range(0x3100)]
    c = F.col("c")
    bare = F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    split = F.split(c, "\r\n|" + M.BREAKS)
    right = F.transform(F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    rows = spark.createDataFrame([*texts, ("a\r\nb\r\r\nc \n\rd\r\n",)], "c string")
    assert rows.filter((X.strip(c) != bare) | (M.lines(c) != right)).count() == 0


def test_bundle_is_cut_in_parts(spark):
    rows = [("k", "md", f"p{i}", "x" * (i % 7) * 3, i) for i in range(300)] + [("empty", "md", "p", " ", 1), ("empty", "md", "q", None, 2), (None, "md", "n", "t", 1), ("k", None, "none", "t", -1)]
    got = {r.k: r.bundle for r in R.bundle(spark.createDataFrame(rows, "k string, kind string, path string, content string, ord int"), ["k"], limit=700).collect()}
    blocks = [f"[reference] md / {p}\n{c}" for k, _, p, c, _ in rows[:300] if c]
    assert got == {"k": "\n\n".join(blocks)[:700], "empty": "(no references)", None: "[reference] md / n\nt"}


def test_bundle_is_cut_at_any_place(spark):
    """A cut may fall into what stands between two blocks, which is then there up to the cut."""
    texts = {k: ["x" * (k + 1), "yy", "z" * 9] for k in range(60)}
    rows = [(k, "md", f"p{i}", c, i) for k, each in texts.items() for i, c in enumerate(each)]
    got = {r.k: r.bundle for r in R.bundle(spark.createDataFrame(rows, "k int, kind string, path string, content string, ord int"), ["k"], limit=70).collect()}
    whole = {k: "\n\n".join(f"[reference] md / p{i}\n{c}" for i, c in enumerate(each)) for k, each in texts.items()}
    assert got == {k: t[:70] for k, t in whole.items()} and {t[69:71] for t in whole.values()} >= {"x\n", "\n\n", "\n["}


def test_reference_bundle_equals_its_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    rows = [(i, "x" * n, f"s{n}") for n in range(39960, 40001) for i in range(4)]
    rows += [(i, f"{chr(c)}a{chr(c)}", "space") for i, c in enumerate([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2009, 0x2028, 0x2029, 0x3000, 0xFEFF])]
    rows += [(1, "\u00a0", "thin"), (2, " \t\n\r\f", "thin"), (3, "b", "thin"), (1, " ", "empty"), (2, None, "empty"), (3, "", "empty"), (None, "c", "no id"), (1, "d", None), (None, "e", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    right = dict(con.execute(catalogue.ORACLE["reference_bundle"]).fetchall())
    got = {r.source: r.bundle for r in catalogue.reference_bundle(spark, str(tmp_path)).collect()}
    assert got == right and len(right) == 45


def test_replies(spark):
    rows = [('[{"id":1,"answer":"<answer>a</answer>"},1,{"id":"1","answer":"b"}]',), ('{"ans":[{"id":"2","answer":"c"}]}',), ("{bad",), ('[{"id":"3","answer":"x"}] trailing',), (None,)]
    got = P.answers(spark.createDataFrame(rows, "reply string"), id_cols=()).collect()
    assert {(r.qid, r.answer) for r in got} == {("1", "b"), ("2", "c")}


def test_guarded_merge(spark):
    original = {"homework_name": "h", "class_name": "c", "student_id": "7", "name": "n", "ans": ["A", ""], "questions": [{"index": "1", "title": "t", "answer": "old"}], "links": ""}
    candidate = original | {"student_id": "8", "ans": ["b!", "C", "D"], "questions": [{"index": "9", "title": "x", "answer": None}]}
    contexts = spark.createDataFrame([("d", original)], "doc_id string, context struct<homework_name:string,class_name:string,student_id:string,name:string,ans:array<string>,questions:array<struct<index:string,title:string,answer:string>>,links:string>")
    replies = spark.createDataFrame([("d", 1, json.dumps(candidate)), ("d", 2, "no json")], "doc_id string, seq int, reply string")
    got = with_feedback(contexts, replies).first().context
    assert (got.student_id, got.ans, got.questions[0].answer) == ("7", ["B", "C"], "old")


def test_vector_has_fixed_length(spark):
    rows = spark.createDataFrame([("d", "3-1", "A", 1), ("d", "3-2", "B", 2), ("d", "0", "C", 3), ("d", "51", "D", 4)], "k string, q string, a string, o int")
    assert A.choice_vector(rows, ["k"], "q", "a", "o").first().ans == [""] * 2 + ["B"] + [""] * 47


def test_segments_cover_from_the_first_start_on(spark):
    pages = spark.createDataFrame([("d", p, 800.0) for p in range(3)], "doc_id string, page int, height double")
    starts = spark.createDataFrame([("d", "1", 0, 100.0), ("d", "2", 1, 300.0)], "doc_id string, qid string, page int, y double")
    got = {(r.qid, r.page, r.y0, r.y1) for r in S.page_segments(starts, pages).collect()}
    assert got == {("1", 0, 100.0, 800.0), ("1", 1, 0.0, 300.0), ("2", 1, 300.0, 800.0), ("2", 2, 0.0, 800.0)}


def test_merge_down():
    import numpy as np

    got = merge_down([np.zeros((1, 2, 3), np.uint8), np.zeros((1, 1, 3), np.uint8)])
    assert got.shape == (2, 2, 3) and got[1, 1, 0] == 255 and merge_down([]) is None


def _solver(texts):
    def run(requests):
        items = F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(texts).alias("answer")))
        return requests.select("doc_id", F.to_json(items).alias("reply"))

    return run


@pytest.mark.parametrize(("review", "status"), [("PASS", "passed"), ("wrong", "open"), (None, "open"), (" ", "open"), ("no row", "unreviewed")])
def test_choice_rounds(spark, review, status):
    questions = spark.createDataFrame([("1", 0, "q", "c")], "qid string, pos int, question string, context string")
    got = solve(questions, _solver("b"), lambda asked: asked.select("qid", F.lit(review).cast("string").alias("review")).filter(F.lit(review != "no row")), choice=True, rounds=2)
    row = got["answers"].first()
    assert row.status == status and row.answer == ("B" if status == "passed" else "")
    assert vector_of(got["answers"])[0] == row.answer


def test_short_rounds_stop_without_growth(spark):
    questions = spark.createDataFrame([("1", 0, "q", "c")], "qid string, pos int, question string, context string")
    got = solve(questions, _solver("text"), lambda asked: asked.select("qid", F.lit("no").alias("review")), choice=False, rounds=5, patience=1)
    assert (got["answers"].first().answer, got["answers"].first().status) == ("text", "longest")


def test_tools_run_no_code():
    assert arithmetic("2*(3+4)") == 14
    assert use_tool("arithmetic", '{"expression": "__import__(\'os\')"}').startswith("failure")
    assert use_tool("x", "{") == "unknown tool: x"


def test_stage_cache(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    key = stage_key("s", "a")
    assert cached(spark, str(tmp_path), key, make).count() == 3 and cached(spark, str(tmp_path), key, make).count() == 3
    assert len(calls) == 1


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in catalogue.QUERIES[name](spark, SF).collect())


def test_texts_without_markers_are_passed_over(spark):
    pieces = ["*", "_", "`", "#", "[", "](u)", "+", "-", " ", "\u3000", "\n", "1", "\u0663", ".", "a", "\t"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(7))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    always = X.strip(reduce(lambda c, rule: F.regexp_replace(c, *rule), X.MARKDOWN, F.coalesce("t", F.lit(""))))
    assert df.filter(~X.strip_markdown(F.col("t")).eqNullSafe(always)).count() == 0 < df.filter(~F.col("t").rlike(X.MARKER)).count()
