"""From files to rendered documents, with PDF files written here."""

import io
import json
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.__main__ import main
from folioflow.functions import text as X
from folioflow.operators import images as I
from folioflow.operators import references as R
from folioflow.operators import segments as S
from folioflow.plans import documents as D
from folioflow.plans import parsing
from folioflow.plans.rounds import solve
from folioflow.plans.run import Engine, Providers
from folioflow.sinks import render
from folioflow.sinks.docx import docx
from folioflow.sinks.files import save_files
from folioflow.sources import files, pdf, providers
from folioflow.streaming import texts as streams

PAGES = [
    ["Lesson 3 Networks", "Part A: choice", "1. Which layer routes?", "A. link", "B. network", "2. Which port is HTTP?", "A. 80", "B. 22"],
    ["Part B: short answer", "3. What is a switch?", "4. Explain (TCP) \\ slow start", "and its threshold."],
    ["Part C: programming", "5. Write a client."],
]


def pdf_file(pages, packed=False, objects=False):
    """A small PDF file: 12 point lines, 20 apart, from the top."""
    quoted = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    held = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    kids = []
    for i, lines in enumerate(pages):
        body = "BT /F1 12 Tf 50 700 Td 20 TL\n" + "\n".join(f"({quoted(t[: len(t) // 2])}) Tj [({quoted(t[len(t) // 2 :])})] TJ T*" for t in lines) + "\nET"
        data = zlib.compress(body.encode()) if packed else body.encode()
        held[10 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" * packed, data)
        held[11 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (10 + 2 * i)
        kids.append(b"%d 0 R" % (11 + 2 * i))
    held[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] >>" % (b" ".join(kids), len(pages))
    if objects:  # the plain ones go into an object stream
        plain = [(n, v) for n, v in held.items() if b"stream" not in v]
        offsets, body = [], b""
        for n, v in plain:
            offsets.append(b"%d %d" % (n, len(body)))
            body += v + b" "
        head = b" ".join(offsets) + b" "
        data = zlib.compress(head + body)
        held = {n: v for n, v in held.items() if b"stream" in v} | {99: b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(plain), len(head), len(data), data)}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(held.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize(("packed", "objects"), [(False, False), (True, False), (True, True)])
def test_pdf_spans(packed, objects):
    read = pdf.read(pdf_file(PAGES, packed, objects))
    assert [pdf.page_text(spans).split("\n") for _, _, spans in read] == PAGES
    width, height, spans = read[0]
    assert (width, height) == (600, 800)
    tops = [s[5] for s in spans[::2]]
    assert tops == sorted(tops) and abs(tops[1] - tops[0] - 20) < 1e-6 and spans[0][4] == 50 and spans[1][4] == spans[0][6]


def test_pdf_with_a_character_map():
    cmap = b"1 beginbfchar <0003> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    parts = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R] >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>",
        4: b"<< /Type /Page /Contents [5 0 R] /Resources << /Font << /F1 3 0 R >> >> >>", 5: b"<< /Length 60 >>\nstream\nBT /F1 10 Tf 1 0 0 1 20 30 Tm <00030010 0011 0012> Tj ET        \nendstream",
        6: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
    }
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % x for x in parts.items())
    [(_, height, [span])] = pdf.read(data)
    assert span[3] == "éABC" and span[4] == 20 and abs(span[5] - (height - 30 - 8)) < 1e-6
    for bad in (b"", b"no pdf", b"%PDF-1.4 1 0 obj << >> endobj", data + b"trailer << /Encrypt 9 0 R >>"):
        with pytest.raises(ValueError):
            pdf.read(bad)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(pdf_file(PAGES))
    (tmp_path / "in/b.pdf").write_bytes(pdf_file([["Other work", "1. What is IP?"]], packed=True))
    (tmp_path / "in/broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "ref.pdf").write_bytes(pdf_file([["  Routers route. "]]))
    (tmp_path / "notes.md").write_text("  Switches switch.  ", encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00\xd8")
    (tmp_path / "config.toml").write_text('[search]\nurl = "http://x/"\n[identity]\nname = "N"\nid = "7"\nclass = "C"\n')
    return tmp_path


def _decoded(data):
    """Pixels of a PNG file as written here."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", part[:10])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    assert (depth, colour) == (8, 2)
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(height, width, 3)


def test_run(spark, folder):
    asked = []

    def solver(requests):
        asked.append(requests.select("doc_id", "prompt", "ids", F.size("parts").alias("n")).collect())
        items = F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit("").alias("analysis"), F.when(i.isin("1", "2"), "b").otherwise(F.concat(F.lit("answer\n| x | y |\n|---|---|\n| **1** | "), i, F.lit(" |\nend"))).alias("answer")))
        return requests.select("doc_id", F.to_json(F.struct(items.alias("results"), items.alias("answers"))).alias("reply"))

    feedback = spark.createDataFrame([("a", 1, "shorter"), ("a", 2, " ok"), ("a", 3, "ignored")], "doc_id string, seq int, remark string")

    def editor(requests):
        assert all("shorter" in r.prompt and "Lesson 3 Networks" in r.prompt for r in requests.collect())
        return requests.select("doc_id", F.lit(json.dumps({"student_id": "8", "ans": ["A"], "questions": [{"answer": "**brief**"}]})).alias("reply"))

    made = Providers(solver=solver, editor=editor, feedback=feedback, links=spark.createDataFrame([("a", "5", "http://code/5")], "doc_id string, qid string, link string"))
    engine = Engine(spark, str(folder / "out"), files.load_config(str(folder / "config.toml")), made)
    refs = ([str(folder / "ref.pdf"), str(folder / "gone.pdf")], [str(folder / "notes.md"), str(folder / "bad.md")])
    got = engine.run([str(folder / "in")], *refs)
    contexts = {r.doc_id: r.context for r in got["contexts"].collect()}
    assert set(contexts) == {"a", "b"} and [r.doc_id for r in got["errors"].collect()] == ["broken"]
    a = contexts["a"]
    assert (a.homework_name, a.class_name, a.student_id, a.name, a.links) == ("Lesson 3 Networks", "C", "7", "N", "5:http://code/5")
    assert a.ans == ["A", "B"] + [""] * 48 and [(q["index"], q["title"]) for q in a.questions] == [("3", "3. What is a switch?"), ("4", "4. Explain (TCP) \\ slow start\nand its threshold.")]
    assert a.questions[0].answer == "brief" and a.questions[1].answer.startswith("answer\n")
    assert {(r.doc_id, r.kind, r.n) for r in got["counts"].collect()} == {("a", "choice", 2), ("a", "short_answer", 2), ("a", "programming", 1), ("b", "short_answer", 1)}
    assert {r.path.rsplit("/", 1)[1] for r in got["warnings"].collect()} == {"gone.pdf", "bad.md"}
    prompts = {r.doc_id: r for r in asked[0]}
    assert list(prompts) == ["a"] and prompts["a"].ids == ["1", "2"] and prompts["a"].n == 5  # the prompt, and a label and an image each
    assert prompts["a"].prompt.index("Routers route.") < prompts["a"].prompt.index("Switches switch.")
    with zipfile.ZipFile(folder / "out/files/a/Lesson 3 Networks.docx") as archive:
        body = archive.read("word/document.xml").decode()
    assert "<w:tbl>" in body and "brief" in body and "http://code/5" in body and body.index("1. A") < body.index("2. B")
    shots = {(r.doc_id, r.qid): _decoded(bytes(r.content)) for r in got["images"].collect()}
    assert set(shots) == {("a", str(i)) for i in range(1, 6)} | {("b", "1")}
    assert all(x.shape[1] == 1200 and (x == 0).any() and (x == 255).any() for x in shots.values())
    assert (folder / "out/files/problems/a_3.png").exists()
    assert {(r.qid, r.path) for r in got["image_map"].filter("doc_id = 'a'").collect()} == {(str(i), f"problems/a_{i}.png") for i in range(1, 6)}
    assert "Lesson 3 Networks" in got["documents"].filter("doc_id = 'a'").first().text
    n = len(asked)
    engine.run([str(folder / "in")], *refs)
    assert len(asked) == n  # the answers come from the stage tables
    (folder / "notes.md").write_text("other", encoding="utf-8")
    engine.run([str(folder / "in")], *refs)
    assert len(asked) > n


def test_command_line(spark, folder, capsys):
    out = str(folder / "cli")
    assert main([str(folder / "in/b.pdf"), "--folder", str(folder / "in"), "--reference-md", str(folder / "notes.md"), "--reference-md", str(folder / "none.md"), "--out", out], spark) == 0
    told = capsys.readouterr()
    assert "b: 1 short_answer" in told.out and "none.md" in told.err and spark.read.parquet(f"{out}/documents").count() == 1
    assert main(["--folder", str(folder), "--out", out], spark) == 0  # the first PDF of the folder, by path
    (folder / "empty").mkdir()
    assert main(["--folder", str(folder / "empty")], spark) == 1


def test_structure_from_replies(spark):
    whole = {"homework_name": "h", "choice": [{"id": 1, "question": "q"}, 3], "short_answer": [{"question": "r"}], "programming": None}
    rows = [("a", "```json\n" + json.dumps(whole) + "\n```"), ("b", "[1]"), ("c", None), ("d", "{}")]
    names, questions, errors = parsing.items_of_replies(spark.createDataFrame(rows, "doc_id string, reply string"))
    assert {tuple(r) for r in names.collect()} == {("a", "h"), ("d", X.NO_TITLE)} and {r.doc_id for r in errors.collect()} == {"b", "c"}
    assert {(r.doc_id, r.kind, r.pos, r.qid, r.question) for r in questions.collect()} == {("a", "choice", 0, "1", "q"), ("a", "short_answer", 0, "None", "r")}
    assert "Text:\nx" in parsing.parse_requests(spark.createDataFrame([("a", "x")], "doc_id string, content string")).first().prompt


def test_split_by_options_and_numbers(spark):
    text = "T\n1) pick\nA. x\nB. y\n2、 say\nmore\n３． a programming task\n4. 3.14 is\n3.5 is no item? it is 3"
    _, questions = parsing.split_items(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc_id string, content string"))
    got = [(r.kind, r.pos, r.qid, r.question) for r in questions.orderBy("question").collect()]
    assert ("choice", 0, "1", "1) pick\nA. x\nB. y") in got and ("short_answer", 0, "2", "2、 say\nmore") in got and ("programming", 0, "3", "３． a programming task") in got and len(got) == 5


def test_solve_many_documents(spark):
    """Documents stop by themselves: one passes at once, one is never heard, one's answers stop growing."""
    rows = [("a", "1", 0, "q", ""), ("b", "1", 0, "q", ""), ("c", "1", 0, "q", ""), ("c", "2", 1, "q", "")]
    questions = spark.createDataFrame(rows, "doc_id string, qid string, pos int, question string, context string")

    def solver(requests):
        told = F.transform("ids", lambda i: F.struct(i.alias("id"), F.concat(F.lit("t"), F.when(F.col("round") < 3, F.repeat(F.lit("x"), F.col("round"))).otherwise("")).alias("answer")))
        return requests.select("doc_id", F.when(F.col("doc_id") == "b", "no json").otherwise(F.to_json(F.struct(told.alias("answers")))).alias("reply"))

    reviewer = lambda r: r.select("doc_id", "qid", F.when(F.col("doc_id") == "a", "Pass").when((F.col("qid") == "2") & (F.col("round") == 2), "PASS").otherwise("").alias("review"))
    got = solve(questions, solver, reviewer, choice=False, rounds=6, patience=2)
    assert [(r.doc_id, r.qid, r.answer, r.status) for r in got["answers"].collect()] == [("a", "1", "tx", "passed"), ("b", "1", X.NO_ANSWER, "open"), ("c", "1", "txx", "longest"), ("c", "2", "txx", "passed")]
    assert got["log"].filter("doc_id = 'c' and qid = '1'").count() == 4  # rounds 1 and 2 grow, two more don't


def test_files(spark, folder):
    found = files.text_sources(spark, [str(folder / "notes.md"), str(folder / "bad.md"), str(folder / "none")]).collect()
    assert {(r.path.rsplit("/", 1)[1], r.content, r.error) for r in found} == {("notes.md", "Switches switch.", None), ("bad.md", "", "the file isn't UTF-8")}
    assert files.text_sources(spark, str(folder / "notes.md"), limit=3).first().content == "Swi"
    assert [r.path.rsplit("/", 1)[1] for r in files.discovered(spark, str(folder / "in")).collect()] == ["a.pdf", "b.pdf", "broken.pdf"]
    assert files.chosen(spark, str(folder / "in")).endswith("a.pdf")
    with pytest.raises(FileNotFoundError):
        files.chosen(spark, str(folder / "in"), wanted=str(folder / "none.pdf"))
    pages = files.pdf_pages(spark, str(folder / "in"), lambda content: ["x", None] if b"Lesson" in content else 1 / 0)
    assert {(r.path.rsplit("/", 1)[1], r.page, r.text, r.error is None) for r in pages.collect()} == {("a.pdf", 0, "x", True), ("a.pdf", 1, "", True), ("b.pdf", None, "", False), ("broken.pdf", None, "", False)}
    (folder / "p.png").write_bytes(b"abc")
    assert files.images(spark, str(folder)).first().url == "data:image/png;base64,YWJj"
    assert files.load_config(str(folder / "config.toml")).search_url == "http://x/"
    with pytest.raises(FileNotFoundError):
        files.load_config(str(folder / "none.toml"))


def test_images():
    page = np.arange(4 * 3 * 4, dtype=np.uint8).reshape(4, 3, 4)
    part = I.crop(page, 1.2, 2.5)
    assert part.shape == (4, 6, 3) and (part[::2, ::2] == page[1:3, :, :3]).all()
    assert (_decoded(I.png(part)) == part).all() and I.crop(page, 3, 3).size == 0


def test_lines_in_order_and_boxes(spark):
    rows = [("d", 0, 0, 0, 0, 1, "b", 5.0, 10.0, 9.0, 20.0), ("d", 0, 0, 0, 0, 0, "a", 1.0, 11.0, 4.0, 19.0), ("d", 0, 0, 1, 0, 0, "first", 0.0, 1.0, 3.0, 2.0), ("d", 0, 1, 2, 0, 0, "image", 0.0, 0.0, 1.0, 1.0), ("d", 0, 0, 3, 0, 0, " ", 0.0, 0.0, 1.0, 1.0)]
    spans = spark.createDataFrame(rows, "doc_id string, page int, block_type int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.text, r.x0, r.y0, r.x1, r.y1) for r in S.in_reading_order(S.page_lines(spans)).collect()]
    assert got == [("first", 0, 1, 3, 2), ("ab", 1, 10, 9, 20)]


def test_text_parts(spark):
    row = spark.createDataFrame([("p", [("", b"x"), ("l", None)], "http://a", "x", {"a": None})], "p string, images array<struct<label:string,content:binary>>, u string, v string, m map<string,string>")
    got = row.select(X.image_parts(F.col("p"), F.col("images")).alias("parts"), X.link_or(F.col("u")).alias("u"), X.link_or(F.col("v")).alias("v"), X.as_json(F.struct(F.lit("é").alias("a"), F.lit(None).cast("string").alias("b"))).alias("j"), X.hit_line(F.lit(None).cast("string"), F.col("p")).alias("h")).first()
    assert [(x.type, x.text, x.image_url) for x in got.parts] == [("text", "p", None), ("text", "image", None), ("image_url", None, "data:image/png;base64,eA==")]
    assert (got.u, got.v, got.j, got.h) == ("http://a", X.NO_LINK, '{"a":"é","b":null}', "- None: p")


def test_conversation_with_tools():
    said, waits = [], []

    def call(history):
        said.append(len(history))
        if len(said) == 1:
            raise ConnectionError
        if len(said) < 4:
            return {"content": "", "tool_calls": [{"id": "1", "name": "arithmetic", "arguments": '{"expression": "6*7"}'}, {"id": "2", "name": "none", "arguments": "{"}]}
        return {"content": history[-2]["content"] + history[-1]["content"]}

    start = [{"role": "user", "content": "x"}]
    assert providers.converse(call, start, wait=waits.append)["content"] == "42unknown tool: none"
    assert said == [1, 1, 4, 7] and waits == [2.0] and len(start) == 1
    with pytest.raises(TimeoutError):
        providers.converse(lambda h: (_ for _ in ()).throw(TimeoutError()), start, attempts=2, wait=waits.append)


def test_provider_calls(spark):
    def connect():
        def client(request):
            if request["doc_id"] == "b":
                raise ConnectionError
            return request["prompt"].upper()

        return client

    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "doc_id string, prompt string")
    assert {tuple(r) for r in providers.called(rows, connect, "doc_id string").collect()} == {("a", "X"), ("c", "Z")}


def test_search(spark):
    corpus = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(["to be or not", "be", "", None, "to be", "TO BE or"])], "title string, content string")
    asked = spark.createDataFrame([("1", "to be"), ("2", "zzz"), ("3", None)], "qid string, query string")
    for group in (4096, 1):
        got = providers.corpus_search(asked, corpus, ["qid"], 3, group=group).orderBy("rank").collect()
        assert [(r.qid, r.rank, r.title) for r in got] == [("1", 1, "t0"), ("1", 2, "t4"), ("1", 3, "t5")] and got[0].content == "to be or not"
    context = R.search_context(asked, providers.corpus_search(asked, corpus, ["qid"], 1), ["qid"])
    assert {r.qid: r.context for r in context.collect()} == {"1": "- t0: to be or not", "2": X.NO_CONTEXT, "3": X.NO_CONTEXT}


def test_fresh_is_strict(spark, tmp_path):
    kept = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 3.0)], "k string, cached_at double")
    assert [r.k for r in D.fresh(kept, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, changed_at double"), ["k"]).collect()] == ["a"]
    calls = []
    make = lambda: calls.append(1) or spark.range(2)
    for newer, n in ((None, 1), (0.0, 1), (4e9, 2), (None, 2)):
        assert D.cached(spark, str(tmp_path), "k", make, newer).count() == 2 and len(calls) == n


def test_rendering(spark, tmp_path):
    context = ("h/1", "c", "7", "n", ["A", ""], [("1", "t", "p\n| a | b |\n|---|---|\n| 1 |\n<q>&")], "1:x")
    df = spark.createDataFrame([("d", context)], f"doc_id string, context {D.CONTEXT}")
    assert df.select(render.rendered(F.col("context"))).first()[0] == "h/1\n\nc 7 n\n\n1. A\n\n1. t\np\na | b\n1 | \n<q>&\n\n1:x"
    row = render.docx_files(df).first()
    body = zipfile.ZipFile(io.BytesIO(row.content)).read("word/document.xml").decode()
    assert row.file_name == "h_1.docx" and len(re.findall("<w:tc>", body)) == 4 and "&lt;q&gt;&amp;" in body
    for _ in range(2):
        save_files(render.docx_files(df).withColumnRenamed("file_name", "path"), str(tmp_path), overwrite=False)
    assert len(list(tmp_path.glob("h_1*.docx"))) == 2
    assert docx("a\x00", [], [], [], []) == docx("a", [], [], [], [])


def test_stream(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "**a**")], schema).write.parquet(str(tmp_path / "in"))
    for n in (1, 2):
        streams.write_available(streams.cleaned(streams.read_documents(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert [r.clean_text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"] * n
        spark.createDataFrame([(2, "a")], schema).write.mode("append").parquet(str(tmp_path / "in"))
