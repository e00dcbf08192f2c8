"""Carries over blocks, the indexed search, loops and stages that go on where they were broken off, and calls that fail."""

import http.server
import json
import random
import threading
import time
import urllib.parse
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.functions.text import NO_CONTEXT
from folioflow.operators import references as R
from folioflow.operators import segments as S
from folioflow.operators.carry import carried
from folioflow.operators.references import search_context
from folioflow.plans import documents as D
from folioflow.plans import parsing, stages
from folioflow.plans.rounds import solve
from folioflow.plans.run import Engine, Providers
from folioflow.sources import files, providers
from folioflow.tables import Tables
from test_run import pdf_file


@pytest.mark.parametrize("span", [1, 3, 7, 4096])
def test_carry_against_a_loop(spark, span):
    drawn = random.Random(span)
    rows = [(drawn.choice(["a", "b", None]), at, drawn.random() < 0.3, drawn.choice([None, None, f"h{at}"])) for at in drawn.sample(range(-20, 200), 120)]
    df = spark.createDataFrame(rows, "k string, at int, edge boolean, head string").repartition(4)
    got = carried(df, ["k"], "at", counts={"n": F.col("edge")}, lasts={"last": F.col("head")}, nexts={"next": F.col("head")}, span=span)
    want = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for i, r in enumerate(own):
            want.append((*r, sum(x[2] for x in own[: i + 1]), next((x[3] for x in own[i::-1] if x[3]), None), next((x[3] for x in own[i + 1 :] if x[3]), None)))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_one_long_document_is_spread(spark):
    """The lines of one document go through many tasks, none of which has more than a few blocks of them."""
    lines = spark.range(400_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("at"), (F.col("id") % 1000 == 0).alias("edge"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = carried(lines, ["doc_id"], "at", counts={"item": F.col("edge")}).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 200_000
        assert got.filter("item <> floor(at / 1000) + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_items_of_a_long_text(spark):
    text = "Name\n" + "\n".join(f"{i % 900 + 1}. item {i}\nmore" for i in range(9000))
    names, items = parsing.split_items(spark.createDataFrame([("d", text), ("e", "only a name")], "doc_id string, content string"))
    got = {r.pos: (r.qid, r.question) for r in items.collect()}
    assert len(got) == 9000 and all(got[i] == (str(i % 900 + 1), f"{i % 900 + 1}. item {i}\nmore") for i in range(9000))
    assert {tuple(r) for r in names.collect()} == {("d", "Name"), ("e", "only a name")}


def test_segments_meet_lines_by_strips(spark):
    """Against a loop, with lines outside the page, pages without a height, and segments without lines."""
    drawn = random.Random(6)
    pages = [("d", p, h) for p, h in enumerate([800.0, 800.0, 0.0, 100.0])]
    lines = [("d", drawn.randrange(4), y, y + drawn.choice([1.0, 12.0, 300.0])) for y in (drawn.uniform(-100, 1000) for _ in range(400))]
    segments = [("d", str(i), p, y, y + drawn.choice([3.0, 50.0, 900.0])) for i in range(60) for p, y in [(drawn.randrange(4), drawn.uniform(-50, 900))]]
    got = S.tight_segments(spark.createDataFrame(segments, "doc_id string, qid string, page int, y0 double, y1 double"), spark.createDataFrame(lines, "doc_id string, page int, y0 double, y1 double"), spark.createDataFrame(pages, "doc_id string, page int, height double"))
    want = set()
    for d, q, p, y0, y1 in segments:
        inside = [(a, b) for _, lp, a, b in lines if lp == p and b >= S.MARGIN and a <= pages[p][2] - S.MARGIN and a >= y0 - S.TOLERANCE and b <= y1 + S.TOLERANCE]
        top, bottom = (max(y0, min(a for a, _ in inside) - S.PADDING), min(y1, max(b for _, b in inside) + S.PADDING)) if inside else (y0, y1)
        want |= {(d, q, p, top, bottom)} if bottom > top else set()
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize(("frequent", "k"), [(0, 3), (3, 2), (64, 5), (256, 1)])
def test_search_against_all_pairs(spark, monkeypatch, frequent, k):
    """Ties, words that every row has, rows that share only frequent words, and none."""
    monkeypatch.setattr(R, "FREQUENT", frequent)
    drawn = random.Random(frequent)
    pool = [f"w{i}" for i in range(80)]
    draw = lambda n: sorted({pool[int(drawn.paretovariate(0.6)) % 80] for _ in range(n)})
    held = [(i, draw(drawn.randint(0, 25))) for i in range(150)] + [(1000 + i, ["w1", "w2"]) for i in range(30)] + [(5000, None)]
    asked = [(f"q{i}", draw(drawn.randint(1, 12))) for i in range(40)] + [("none", ["zzz"]), ("empty", []), ("null", None), ("q0", [])]
    got = R.most_shared(spark.createDataFrame(asked, "qid string, words array<string>"), spark.createDataFrame(held, "id int, words array<string>").repartition(3), ["qid"], ["id"], k, group=7)
    want = set()
    for q, words in asked:
        best = sorted((-len(set(words or []) & set(w or [])), i) for i, w in held)
        want |= {(q, rank + 1, i, -n) for rank, (n, i) in enumerate(x for x in best[:k] if x[0])}
    assert {tuple(r) for r in got.collect()} == want


def _loop(spark, folder, asked, stop=None, where="reviewer"):
    """Question n passes in round n; ``stop``: the round in which a provider breaks down."""
    rows = [(f"d{i % 3}", str(i), i, "q", "") for i in range(1, 7)]
    questions = spark.createDataFrame(rows, "doc_id string, qid string, pos int, question string, context string")

    def solver(requests):
        turn = requests.select("round").first()[0]
        asked.append(("solver", turn))
        if where == "solver" and turn == stop:
            raise RuntimeError("the driver is lost")
        items = F.transform("ids", lambda i: F.struct(i.alias("id"), F.concat(F.lit("b"), i).alias("answer")))
        return requests.select("doc_id", F.to_json(F.struct(items.alias("results"))).alias("reply"))

    def reviewer(requests):
        turn = requests.select("round").first()[0]
        asked.append(("reviewer", turn))
        if where == "reviewer" and turn == stop:
            raise RuntimeError("the driver is lost")
        return requests.select("doc_id", "qid", F.when(F.col("qid").cast("int") <= F.col("round"), "PASS").otherwise(F.concat(F.lit("wrong "), "round")).alias("review"))

    return solve(questions, solver, reviewer, choice=True, rounds=8, folder=folder)


@pytest.mark.parametrize("where", ["reviewer", "solver"])
def test_a_broken_loop_goes_on(spark, tmp_path, where):
    first, second, whole = [], [], []
    with pytest.raises(RuntimeError):
        _loop(spark, str(tmp_path / "a"), first, stop=4, where=where)
    got = _loop(spark, str(tmp_path / "a"), second)
    turns = lambda told, who: [n for w, n in told if w == who]
    assert turns(first, "reviewer") == [1, 2, 3] + [4] * (where == "reviewer")
    assert turns(second, "reviewer") == [4, 5, 6] and turns(second, "solver") == ([5, 6] if where == "reviewer" else [4, 5, 6])  # replies that were written aren't asked for again
    other = _loop(spark, str(tmp_path / "b"), whole)
    assert sorted(map(tuple, got["log"].collect())) == sorted(map(tuple, other["log"].collect())) and got["answers"].collect() == other["answers"].collect()
    assert [n for n in got["tables"].names() if n.startswith(("pending", "replies"))] == []  # a round's own tables go
    third = []
    assert _loop(spark, str(tmp_path / "a"), third)["answers"].count() == 6 and third == []
    got["tables"].close()
    assert not Path(got["tables"].folder).exists()


def test_a_changed_document_among_many(spark, tmp_path):
    """One of 1,000 documents is made again; one without rows isn't made twice."""
    made = []

    def make(ids):
        made.append(sorted(r.doc_id for r in ids.collect()))
        return ids.filter("doc_id <> 'd7'").select("doc_id", F.lit("1").alias("qid"), F.concat(F.lit("of "), "doc_id", F.lit(f" in {len(made)}")).alias("answer"))

    def run(texts, changed=1.0, references="r"):
        docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
        asked = docs.select("doc_id", stages.content_key(F.lit("s"), F.col("text"), F.lit(references)).alias("key"), F.lit(changed).alias("changed_at"))
        return {r.doc_id: r.answer for r in stages.staged(Tables(spark, str(tmp_path)), asked, make, "qid string, answer string").collect()}

    texts = {f"d{i}": f"text {i}" for i in range(1000)}
    assert len(run(texts)) == 999 and len(made[0]) == 1000
    assert len(run(texts)) == 999 and len(made) == 1
    got = run(texts | {"d3": "changed"})
    assert made[1:] == [["d3"]] and got["d3"] == "of d3 in 2" and got["d4"] == "of d4 in 1"
    assert run(texts)["d3"] == "of d3 in 1" and len(made) == 2  # the earlier text is still known
    assert set(run({"d1": "text 1"})) == {"d1"} and len(made) == 2
    run({"d1": "text 1"}, references="other")
    run({"d1": "text 1", "d2": "text 2"}, changed=time.time() + 1e6)  # touched since
    assert made[2:] == [["d1"], ["d1", "d2"]]


def test_batches_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "BATCHES", 2)
    tables = Tables(spark, str(tmp_path))
    for i in range(6):
        asked = spark.createDataFrame([(f"d{j}", "k", 0.0) for j in range(i + 1)], "doc_id string, key string, changed_at double")
        assert stages.staged(tables, asked, lambda ids: ids.select("doc_id", F.lit(1).alias("n")), "n int").count() == i + 1
    assert len(tables.names()) <= 3
    (tmp_path / "batch-99999999999999999999").mkdir()  # half written
    assert stages.staged(tables, asked, lambda ids: pytest.fail("nothing is stale"), "n int").count() == 6


def test_keys_tell_parts_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("1s", "a"), ("a", None), ("a", "")]
    got = spark.createDataFrame(rows, "x string, y string").select(stages.content_key(F.col("x"), F.col("y"))).distinct().count()
    assert got == len(rows)


def test_one_changed_file_of_a_run(spark, tmp_path):
    asked = []

    def solver(requests):
        asked.append(sorted(r.doc_id for r in requests.select("doc_id").collect()))
        return providers.offline_solver(requests)

    (tmp_path / "in").mkdir()
    for name in "abc":
        (tmp_path / f"in/{name}.pdf").write_bytes(pdf_file([[f"Work {name}", "1. What is IP?", "2. A programming task"]]))
    (tmp_path / "prompt.txt").write_text("Put it in a repository.\n", encoding="utf-8")
    engine = Engine(spark, str(tmp_path / "out"), providers=Providers(solver=solver, link_prompt=str(tmp_path / "prompt.txt")))
    got = engine.run([str(tmp_path / "in")])
    assert asked == [["a", "b", "c"]] and got["metrics"] == {"items": 6, "choice": 0, "short_answer": 3, "programming": 3}
    assert {r.prompt for r in got["requests"].collect()} == {"Put it in a repository.\n\n2. A programming task"}
    engine.run([str(tmp_path / "in")])
    (tmp_path / "in/b.pdf").write_bytes(pdf_file([["Work b", "1. What is TCP?"]]))
    got = engine.run([str(tmp_path / "in")])
    assert asked[1:] == [["b"]] and {r.doc_id: r.context.questions[0].title for r in got["contexts"].collect()}["b"] == "1. What is TCP?"
    with pytest.raises(FileNotFoundError):
        files.prompt_text(spark, str(tmp_path / "none.txt"))


def test_calls_that_fail(spark, tmp_path):
    """A client that breaks down now and then gives rows, attempts and errors; tools are answered on the way."""

    def connect():
        seen, busy, most, lock = {}, [0], [0], threading.Lock()

        def client(history):
            name = history[0]["content"]
            with lock:
                seen[name] = seen.get(name, 0) + 1
                busy[0] += 1
                most[0] = max(most[0], busy[0])
            time.sleep(0.02)
            with lock:
                busy[0] -= 1
            if name == "never" or (name.startswith("late") and seen[name] < 3):
                raise ConnectionError("no answer")
            if name == "broken":
                raise ValueError("bad request")
            if name == "tool" and len(history) == 1:
                return {"content": "", "tool_calls": [{"id": "1", "name": "arithmetic", "arguments": '{"expression": "6*7"}'}]}
            return {"content": f"{history[-1]['content']} {most[0] <= 2}"}

        return client

    rows = [(str(i), p) for i, p in enumerate(["x", "never", "late1", "broken", "tool", "late2"] + ["y"] * 20)]
    df = spark.createDataFrame(rows, "doc_id string, prompt string").coalesce(1)
    settings = {"messages": lambda r: [{"role": "user", "content": r["prompt"]}], "at_once": 2, "pause": 0.0}
    got = {r.doc_id: r for r in providers.calls(df, connect, "doc_id string", **settings).collect()}
    assert len(got) == len(rows) and (got["0"].reply, got["0"].attempts, got["0"].error) == ("x True", 1, None)
    assert (got["1"].reply, got["1"].attempts, got["1"].error) == (None, 3, "ConnectionError: no answer")
    assert (got["2"].reply, got["2"].attempts) == ("late1 True", 3) and (got["3"].attempts, got["3"].error) == (1, "ValueError: bad request")
    assert (got["4"].reply, got["4"].attempts) == ("42 True", 2)
    tables = Tables(spark, str(tmp_path))
    came = providers.called(df, connect, "doc_id string", failures=lambda all_rows: tables.write(all_rows, "calls"), **settings)
    assert {r.doc_id for r in came.collect()} == set(got) - {"1", "3"} and tables.read("calls").filter("error is not null").count() == 2


def test_calls_keep_their_pace():
    pace, began = providers.Pace(50), time.monotonic()
    threads = [threading.Thread(target=lambda: [pace() for _ in range(5)]) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert time.monotonic() - began >= 19 / 50


def test_a_query_text_is_searched_once(spark, tmp_path):
    told = []

    def search(questions):
        told.append(questions.collect())
        return questions.select("doc_id", "qid", F.lit(1).alias("rank"), F.lit("t").alias("title"), F.concat(F.lit("of "), "query").alias("content"))

    rows = [("a", "1", "same"), ("b", "1", "same"), ("b", "2", "other"), ("c", "1", None)]
    got = providers.once(search, Tables(spark, str(tmp_path)))(spark.createDataFrame(rows, "doc_id string, qid string, query string"))
    assert {(r.doc_id, r.qid, r.content) for r in got.collect()} == {(d, q, f"of {t or ''}") for d, q, t in rows} and sorted(r.query for r in told[0]) == ["", "other", "same"]


class _Service(http.server.BaseHTTPRequestHandler):
    """Replies by the query's text; the server's ``asked`` tells what came."""

    def do_GET(self):
        at = urllib.parse.urlsplit(self.path)
        given = urllib.parse.parse_qs(at.query, keep_blank_values=True)
        query = given["q"][0]
        self.server.asked.append((at.path, query, given["format"][0]))
        hits = [{"title": f"{query} {i}", "content": f"c{i}"} for i in range(7)]
        body = {"many & more": {"results": hits}, "odd": {"results": [{"content": 5}, {"title": "t"}]}, "none": {"results": []}, "other": [1], "down": {"results": hits[:1]}}.get(query, "no object")
        self.send_response(500 if query == "down" else 200)
        self.end_headers()
        self.wfile.write(b"{" if query == "broken" else json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_search_by_a_service(spark, tmp_path):
    """Hits, gaps, no results and failures become contexts; each text is asked for once; a service that isn't there is tried again."""
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Service) as server:
        server.asked = []
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_port}/"
        queries = ["many & more", "many & more", "odd", "none", "other", "broken", "down", None]
        asked = spark.createDataFrame([("d", str(i), q) for i, q in enumerate(queries)], "doc_id string, qid string, query string")
        hits = providers.once(providers.service_search(base, pause=0.0), Tables(spark, str(tmp_path / "a")))(asked)
        got = {int(r.qid): r.context for r in search_context(asked, hits, ["doc_id", "qid"]).collect()}
        server.shutdown()
    assert got[0] == got[1] == "\n".join(f"- many & more {i}: c{i}" for i in range(5))
    assert got[2] == "- None: 5\n- t: None" and got[3] == NO_CONTEXT and got[6] == "- down 0: c0"
    assert all(got[i].startswith("failure: ") for i in (4, 5, 7)) and len(got) == len(queries)
    assert sorted(q for _, q, _ in server.asked) == sorted({q or "" for q in queries}) and {(p, f) for p, _, f in server.asked} == {("/search", "json")}
    gone = providers.service_search(base, pause=0.0, attempts=2)(asked.limit(1)).collect()
    assert len(gone) == 1 and gone[0].rank is None and gone[0].error.startswith("ConnectionError")
    with pytest.raises(ValueError, match="not the address"):
        providers.service_search("file:///etc/")


def test_link_requests(spark):
    items = spark.createDataFrame([("a", "1", "q"), ("a", "2", None)], "doc_id string, qid string, question string")
    assert [r.prompt for r in D.link_requests(items, " \n").collect()] == ["q", ""] and D.link_requests(items, "p").first().prompt == "p\n\nq"
