"""Word-run phrases and the positional index against SQLite; cells and selection against brute force."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import cells, ranking, reports, vectors, wordindex


def _sqlite(docs, queries):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    db.executemany("insert into f(rowid, t) values (?, ?)", [(i + 1, t) for i, t in docs])
    out = {}
    for q, text in queries:
        words = __import__("re").findall(r"\w+", text)
        if words:
            match = " OR ".join(f'"{w}"' for w in words)
            out |= {(q, r - 1): -s for r, s in db.execute("select rowid, bm25(f) from f where f match ?", [match])}
    return out


def _frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("indexed", [False, True])
def test_runs_of_words_equal_sqlite(spark, indexed, monkeypatch):
    monkeypatch.setattr(wordindex, "TILE", 7)
    rng = random.Random(5)
    vocab = ["foo", "bar", "baz", "qux", "running", "foo_bar", "a1", "b", "né"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(25)))) for i in range(60)] + [(60, ""), (61, "foo bar baz"), (62, "foo_bar running"), (63, "bar foo"), (64, None)]
    queries = [(1, "foo_bar"), (2, "foo bar"), (3, "foo_bar baz qux_a1"), (4, "foo_foo foo_foo né"), (5, "!?"), (6, ""), (7, "nothing_here b"), (8, "__foo__bar__baz"), (9, None)]
    d, q = _frames(spark, docs, queries)
    index = wordindex.positional(d) if indexed else None
    got = {(r.query_id, r.doc_id): r.score for r in wordindex.scored(d, q, phrases=True, index=index).collect()}
    want = _sqlite([(i, t or "") for i, t in docs], [(i, t or "") for i, t in queries])
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert {d_ for q_, d_ in got if q_ == 1} >= {61, 62} and (1, 63) not in got


def test_best_by_tiles_equals_joins(spark, monkeypatch):
    monkeypatch.setattr(wordindex, "TILE", 5)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 10, 10, 40])))) for i in range(90)] + [(200 + i, "w1 w2 w3") for i in range(9)]
    queries = [(i, " ".join(rng.choice([*vocab, "none"]) for _ in range(rng.randrange(6)))) for i in range(25)]
    d, q = _frames(spark, docs, queries)
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    for within in (None, d.where("doc_id % 3 = 0")):
        for newest in (False, True):
            assert rows(wordindex.best(d, q, 4, newest=newest, within=within)) == rows(ranking.best(ranking.bm25(d, q, within), 4, newest=newest))
    monkeypatch.setattr(wordindex, "MOST_QUERIES", 2)
    assert rows(wordindex.best(d, q, 4)) == rows(ranking.best(ranking.bm25(d, q), 4))
    assert wordindex.best(d.limit(0), q, 3).collect() == [] and wordindex.best(d, q.limit(0), 3).collect() == []


@pytest.mark.parametrize("most", [4096, 1])
def test_phrases_and_upkeep(spark, monkeypatch, most):
    monkeypatch.setattr(wordindex, "MOST_QUERIES", most)
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for i in range(40)] + [(50, None)]
    queries = [(1, "a b"), (2, "a a"), (3, "c"), (4, "a b a b"), (5, ""), (6, "z a")]
    d, q = _frames(spark, docs, queries)
    count = lambda t, p: sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1)) if p else 0
    want = {(k, i): n for k, p in queries for i, t in docs if (n := count((t or "").split(), p.split()))}
    assert {(r.query_id, r.doc_id): r.n for r in wordindex.phrase(d, q).collect()} == want
    changed = spark.createDataFrame([(1, "a a a"), (77, "b a")], "doc_id long, text string")
    kept = wordindex.repositioned(wordindex.positional(d), changed, spark.createDataFrame([(2,)], "doc_id long"))
    fresh = wordindex.positional(d.where("doc_id not in (1, 2)").unionByName(changed))
    key = lambda r: (r.doc_id, r.len, sorted((t.term, t.gaps) for t in r.terms))
    assert sorted(map(key, kept.collect())) == sorted(map(key, fresh.collect()))


def _clustered(n, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 50), dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.6 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cells_find_neighbours_and_are_kept_up(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 40)
    x = _clustered(1500)
    rows = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>").union(spark.createDataFrame([(9999, None)], "vec_id long, embedding array<float>"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centres = cells.learnt(rows)
    assert centres.shape == (38, 32) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    index = cells.assigned(rows, centres)
    exact = vectors.nearest(rows, asked, 10, others_only=True)
    found = cells.nearest(index, centres, asked, 10, probes=4, others_only=True)
    told = cells.recall(found, exact).agg(F.sum("hits") / F.sum("wanted")).first()[0]
    scanned = found.groupBy("query_id").agg(F.max("scanned").alias("s")).agg(F.avg("s")).first()[0]
    assert told >= 0.95 and scanned < 0.2 * 1500
    # all cells: exact, ties and all
    key = lambda df: sorted((r.query_id, r.vec_id, r.cosine, r["rank"]) for r in df.collect())
    assert key(cells.nearest(index, centres, asked, 10, probes=99, others_only=True)) == key(exact)
    changed = spark.createDataFrame([(0, [float(v) for v in x[7]]), (5000, [float(v) for v in x[9]])], "vec_id long, embedding array<float>")
    after = cells.updated(index, centres, changed, rows.where("vec_id between 100 and 900"))
    held = {r.vec_id: r.cell for r in after.collect()}
    assert held.keys() == ({*range(1500)} - {*range(100, 901)}) | {5000} and held[0] == held[7] and held[5000] == held[9]


def test_selected_places_equal_sorting(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([rng.uniform(-1e9, 1e9), rng.gauss(0, 1), 3.0, float(rng.randrange(4)), None, 1e-300 * rng.random()])) for k in ("a", "b", None) for _ in range(700)] + [("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    places = [(k, p) for k in ("a", "b", None) for p in (1, 2, 17, 300, 500)] + [("one", 1), ("one", 2), ("none", 1), ("a", 0)]
    got = {(r.k, r.place): r.found for r in reports.order_statistics(df, ["k"], "v", spark.createDataFrame(places, "k string, place long")).collect()}
    own = {k: sorted(v for g, v in rows if g == k and v is not None) for k in {k for k, _ in rows}}
    assert got == {(k, p): own[k][p - 1] for k, p in places if 1 <= p <= len(own[k])}
    whole = reports.order_statistics(df, [], "v", spark.createDataFrame([(9,)], "place long")).collect()
    assert [r.found for r in whole] == [sorted(v for _, v in rows if v is not None)[8]]
    plan = reports.exclusive_quantile(df, ["k"], "v", 19, 20)
    assert "Window" not in plan._jdf.queryExecution().toString()
    import statistics

    for r in plan.collect():
        assert r.n == len(own[r.k]) and (r.quantile is None if r.n < 2 else math.isclose(r.quantile, statistics.quantiles(own[r.k], n=20)[18], rel_tol=1e-12, abs_tol=1e-300))
