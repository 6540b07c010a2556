"""Stemming against SQLite, variants, whole searches, indexing passes, notes and event streams."""

import hashlib
import json
import random
import sqlite3
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import stemming
from lexmill.operators import search
from lexmill.sources import markdown, notes, readers


def test_stems_equal_sqlite(spark):
    rng = random.Random(7)
    ends = [*stemming.STEP2, *stemming.STEP3, *stemming.STEP4, "s", "sses", "ies", "eed", "ed", "ing", "y", "e", "ll", ""]
    words = sorted({"".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(1, 7))) + rng.choice(ends) + rng.choice(["", "", *ends]) for _ in range(6000)} | {"connected", "relational", "skies", "hopping", "café"})
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='porter unicode61 remove_diacritics 0')")
    db.execute("create virtual table v using fts5vocab(f, 'instance')")
    db.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(words)))
    want = {words[doc]: term for term, doc in db.execute("select term, doc from v")}
    got = {r.term: r.stem for r in stemming.stems_of(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert {w: s for w, s in got.items() if w in want} == want


def test_pieces(spark):
    vocab = {"un", "##aff", "##able", "a", "##b"}
    got = spark.createDataFrame([(["unaffable", "ab", "zz"],), (None,)], "w array<string>").select(stemming.pieces(F.col("w"), vocab).alias("p")).collect()
    assert got[0].p == ["un", "##aff", "##able", "a", "##b", "[UNK]"] and got[1].p == []


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["words", "meaning", "fused"]), st.floats(0, 1e20), st.integers(0, 2), st.floats(0, 9), st.sampled_from([None, "mini-l6"]), st.integers(1, 40))
def test_variants_round_trip(side, weight, hops, link, judge, top):
    v = search.Variant(side, weight if side == "fused" else search.WORD_WEIGHT, hops, link if hops else 0.0, judge, top if judge else 0)
    assert search.Variant.parse(v.name) == v


@pytest.mark.parametrize("name", ["", "fused:0.2", "words:0.3", "fused:.3", "fused+hop3x0.1", "fused+hop1x-0.0", "fused:nan", "fused+rerank:x@0", "fused+hop1x0.30", "fused+hop0x0.0"])
def test_other_spellings_are_refused(name):
    with pytest.raises(ValueError):
        search.Variant.parse(name)


def test_find(spark):
    docs = spark.createDataFrame([(1, "cat sat"), (2, "cat cat"), (3, "dog"), (4, "bird bird"), (5, "fish")], "doc_id long, text string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (5, [0.6, 0.8])], "vec_id long, embedding array<float>")
    links = spark.createDataFrame([(2, 4)], "doc_id long, to long")
    corpus = search.Corpus(docs, vecs, links, spark.createDataFrame([(2,)], "doc_id long"))
    q = spark.createDataFrame([(7, "cat", [1.0, 0.0]), (8, "?", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    run = lambda v, **k: [(r.place, r.doc_id, r.withheld) for r in search.find(corpus, q, search.Variant.parse(v), 3, **k).orderBy("query_id", "place").collect()]
    assert run("words") == [(1, 2, 0), (2, 1, 0)]
    assert run("words", private=False) == [(1, 1, 1)]
    assert run("meaning") == [(1, 1, 0), (2, 3, 0), (3, 5, 0)]
    assert run("fused")[0] == (1, 1, 0)
    assert [d for _, d, _ in run("words+hop1x0.5")] == [2, 1, 4]
    judge = lambda rows: rows.select("query_id", "doc_id", F.when(F.col("body").contains("sat"), 9.0).otherwise(1.0).alias("judged"))
    assert [d for _, d, _ in run("words+rerank:toy@2", judges={"toy": judge})] == [1, 2]
    also = spark.createDataFrame([(7, 0, "bird", [0.0, 1.0]), (8, 0, "bird", [0.0, 1.0])], "query_id long, n int, text string, embedding array<float>")
    for merge in ("best", "reciprocal"):
        assert {d for _, d, _ in run("words", also=also, merge=merge)} == {1, 2, 4}


def test_recall_and_forget(spark):
    turns = spark.createDataFrame([(1, 10, "red car"), (2, 20, "red car"), (3, 30, "blue car")], "doc_id long, at int, text string")
    q = spark.createDataFrame([(1, "red"), (2, "!")], "query_id long, text string")
    got = {(r.query_id, r["rank"]): r.doc_id for r in search.recall(turns, q, 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 3, (2, 2): 2}
    assert {r.doc_id for r in search.recall(turns, q, 2, since=F.lit(15), until=F.lit(30)).where("query_id = 1").collect()} == {2}
    assert {r.doc_id for r in search.forget(turns, spark.createDataFrame([(1, "car red"), (2, "")], "query_id long, text string")).collect()} == {3}


def test_index_pass_is_idempotent(spark):
    text = lambda rows: spark.createDataFrame(rows, "doc_id long, size long, sha256 string, text string")
    docs = spark.createDataFrame([], "doc_id long, size long, sha256 string, recipe string")
    chunks = spark.createDataFrame([], "doc_id long, ordinal int, start_line int, end_line int, body string, cut boolean")
    d1, c1, r1 = search.index_pass(text([(1, 3, "a", "x\ny"), (2, 1, "b", "z")]), docs, chunks, "r")
    assert {r.outcome: r.n for r in r1.collect()} == {"added": 2} and c1.count() == 2
    d2, c2, r2 = search.index_pass(text([(1, 3, "a", "x\ny"), (2, 1, "c", "w")]), d1, c1, "r")
    assert {r.outcome: r.n for r in r2.collect()} == {"unchanged": 1, "changed": 1}
    assert sorted((r.doc_id, r.body) for r in c2.collect()) == [(1, "x\ny"), (2, "w")] and d2.count() == 2
    _, c3, r3 = search.index_pass(text([(2, 1, "c", "w")]), d2, c2, "r")
    assert {r.outcome: r.n for r in r3.collect()} == {"unchanged": 1, "vanished": 1} and [r.doc_id for r in c3.collect()] == [2]


def test_links_of_files(spark):
    md = "[[Plan#Next|the plan]] `[[no]]` [a](../b/c%20d.md#x) [u](https://x.y) [up](../../z.md) ![i](p.png)\n```\n[[no]]\n```"
    py = "import os, numpy.linalg\nfrom . import x\nfrom ..up import y\nfrom pkg.m import z"
    files = spark.createDataFrame([("n/a.md", "markdown", md), ("p/q/m.py", "python", py), ("bad.py", "python", "def")], "path string, kind string, text string")
    got = sorted((r.path, r.kind, r.target, r.anchor) for r in notes.links(files).collect())
    assert got == [("n/a.md", "markdown", "b/c d.md", "x"), ("n/a.md", "wikilink", "plan", "Next"), ("p/q/m.py", "import", "numpy.linalg", None), ("p/q/m.py", "import", "p.q.x", None), ("p/q/m.py", "import", "p.up", None), ("p/q/m.py", "import", "pkg.m", None)]
    assert list(notes.python_blocks("import a\n\n@d\ndef f():\n    pass\nx = 1")) == [(1, 2, ""), (3, 5, "f"), (6, 6, "")]


STREAM = 'event: x\r\ndata: {"choices": [{"delta": {"content": "He"}}]}\r\n\r\n: note\ndata: {"choices": [{"delta": {"content": "y"}, "finish_reason": "stop"}],\ndata: "usage": {"total_tokens": 5}}\n\ndata: [DONE]\n\ndata: lost'


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, len(STREAM)), max_size=8))
def test_events_do_not_depend_on_the_pieces(cuts):
    bounds = [0, *sorted(cuts), len(STREAM)]
    parser = notes.EventParser()
    got = [e for a, b in zip(bounds, bounds[1:], strict=False) for e in parser.feed(STREAM[a:b])]
    assert got == list(notes.EventParser().feed(STREAM)) and [k for k, _ in got] == ["x", "message", "message"]


def test_tool_calls_joined_by_index(spark):
    part = lambda **x: 'data: {"choices": [{"delta": {"tool_calls": [' + json.dumps(x) + "]}}]}\n\n"
    text = part(index=1, id="b", function={"name": "g", "arguments": "{"}) + part(index=0, id="a", function={"name": "f"}) + part(index=1, id="z", function={"name": "h", "arguments": "}"}) + part(index=0, function={"arguments": '{"k": 1}'})
    out = notes.answers(spark.createDataFrame([("s", i, text[i * 40 : i * 40 + 40]) for i in range(20)], "stream string, at int, piece string")).first()
    assert [(c["index"], c.id, c.name, c.arguments) for c in out.tool_calls] == [(0, "a", "f", '{"k": 1}'), (1, "b", "g", "{}")]


def test_carriage_returns_end_lines():
    parser = notes.EventParser()
    got = [e for c in "data: a\r\rdata: b\r\n\r\ndata: c\n\r" for e in parser.feed(c)]
    assert got + list(parser.close()) == [("message", "a"), ("message", "b"), ("message", "c")]
    with pytest.raises(ValueError):
        list(notes.EventParser(10).feed("data: much too long"))


def test_markdown_notes():
    text = '---\ntitle: "The Plan"\nrelated:\n  - "[[Other]]"\nseen: "[[Third]]"\n...\nbefore [a](x.md)\n   ## Indented ##\n\n# Top\nsaid ![[p.png]] ![[Note]] [b](<../up file.md> "t") [c](https://x) [d](e(1).md#f%20g)\n    # code\n#none\n~~~\n# in code [[no]]\n```\n~~~\n### Last'
    note = markdown.read("n/plan.md", text)
    assert note.title == "The Plan"
    assert [(b.start, b.end, b.trail) for b in note.blocks] == [(1, 6, ()), (7, 7, ()), (8, 18, ("Top",))]
    assert note.links == [(4, "related", "other", None), (5, "wikilink", "third", None), (7, "markdown", "n/x.md", None), (11, "wikilink", "note", None), (11, "markdown", "up file.md", None), (11, "markdown", "n/e(1).md", "f g")]
    assert markdown.read("n/plan.md", "---\nno key\n---\n# One `[[x]]`").title == "One `[[x]]`" and markdown.read("n/plan.md", "").title == "plan"
    assert [markdown.heading(x) for x in ("# a #", "####### a", "#", "## #", "#a", "    # a", "# a#")] == [(1, "a"), None, (1, ""), (2, "#"), None, None, (1, "a#")]


def test_answers(spark):
    rows = [("s", i, STREAM[a:b]) for i, (a, b) in enumerate([(0, 30), (30, 31), (31, len(STREAM))])]
    out = notes.answers(spark.createDataFrame(rows, "stream string, at int, piece string")).first()
    assert (out.text, out.finish, out.total_tokens) == ("Hey", "stop", 5)


def test_event_bytes_ids_and_retry():
    stream = "\ufeffid: 7\nretry: 250\ndata: é1\n\nid: a\0b\nretry: soon\ndata: 2\n\ndata: tail".encode()
    for size in (1, 2, 5, 1000):
        parser = notes.EventParser()
        got = [e for i in range(0, len(stream), size) for e in parser.feed(stream[i : i + size])]
        assert got == [("message", "é1"), ("message", "2")] and (parser.last_id, parser.retry) == ("7", 250)


def test_python_outline_and_cell_links():
    text = "import a\n\n@d\nclass C:\n    x = 1\n\n    def f(self):\n        pass\n\n    @p\n    def g(self): ...\n\ndef h(): ...\n# end"
    got = [(b.start, b.end, b.trail) for b in notes.python_outline(text)]
    assert got == [(1, 2, ()), (3, 6, ("C",)), (7, 9, ("C", "f")), (10, 11, ("C", "g")), (12, 12, ()), (13, 13, ("h",)), (14, 14, ())]
    assert len({b.unit for b in notes.python_outline(text)[1:4]}) == 1 and notes.python_outline("def (") == [notes.Block(1, 1)]
    assert [x[2:] for x in notes.markdown_links("a.md", "| [[Note\\|label]] | [[Other#part\\|x]] |")] == [("note", None), ("other", "part")]


def test_readers_of_answers_verdicts_and_calibration(spark, tmp_path):
    write = lambda name, rows: (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows)) and str(tmp_path / name)
    given = {"id": "q1", "question": "why", "answer": "so", "passages": ["é", 'a "b"\n']}
    got = readers.answers(spark, write("a.jsonl", [given, given | {"id": "q2", "passages": []}])).collect()
    want = {r["id"]: hashlib.sha256(json.dumps(r["passages"]).encode()).hexdigest() for r in (given, {"id": "q2", "passages": []})}
    assert {r.id: r.passages_sha256 for r in got} == want
    with pytest.raises(ValueError, match="given twice"):
        readers.answers(spark, write("b.jsonl", [given, given]))
    verdict = {"question": "why", "answer": "so", "passages_sha256": want["q1"], "supported": True, "claims": ["x"]}
    assert readers.verdicts(spark, write("c.jsonl", [verdict, verdict | {"answer": "no"}])).count() == 2
    label = given | {"origin": "natural", "supported": False}
    assert readers.calibration(spark, write("d.jsonl", [label])).first().origin == "natural"
    for read, rows in ((readers.verdicts, [verdict | {"passages_sha256": "12"}]), (readers.calibration, [label | {"origin": "made up"}]), (readers.calibration, [given | {"origin": "natural"}])):
        with pytest.raises(Exception):  # noqa: B017
            read(spark, write("e.jsonl", rows)).collect()
