"""Queries over small made-up tables on which they once went wrong, against SQL or by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.plans import catalog

from .oracle import rows


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over tables given as DataFrames."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        return rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.sql(catalog.ORACLE_SQL[name]).df())

    return run


def test_user_counts_are_exact(spark, both):
    events = spark.range(60_000).select("id", F.lit("view").alias("event_type"), F.col("id").alias("user_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    got, want = both("approx_users", events=events)
    assert got == want == [("view", 60_000)]


def test_half_minutes_round_to_even(spark, both):
    at = "timestamp_ntz'2024-01-01 00:{}:00'"
    events = spark.sql(f"select * from values (1L, 7L, {at.format('00')}, 2.5D), (2L, 7L, {at.format('03')}, 9D), (3L, 8L, {at.format('00')}, 3.5D), (4L, 8L, {at.format('04')}, 9D) as t(event_id, user_id, ts, value)")
    got, want = both("interval_overlap", events=events)
    assert got == want == [(3, 4)]


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def _items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


REPEATED = ["on on on air", "a b a b", "a b a b a", "x a b y", "on", "and so on on", "air", None]


def test_places_of_phrases_may_overlap_and_adjoin(spark, both):
    got, want = both("phrase_hits", documents=_texts(spark, REPEATED), benchmark=_items(spark, ["a b a", "a b", "on on", "..."]))
    assert got == want and {(1, 2, 1), (2, 2, 0), (2, 2, 1), (0, 2, 2)} <= set(got)  # doc_id, n, query_id


def test_runs_that_overlap_weigh_each(spark, both):
    got, want = both("bm25_phrases", documents=_texts(spark, REPEATED), benchmark=_items(spark, ["on on air", "a b a"]))
    assert got == want and got


def test_references_without_a_semicolon(spark, both):
    html = ["<p>a &amp b &ampere &copy2 &lt</p>", "x &amp;amp y&ampamp", "&notin; &notit; &nosuch; &", "&&&amp</p>", None]
    got, want = both("visible_text", pages=spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    assert got == want and (0, "a & b &ere ©2 <") in got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_few_random_vectors_are_found_by_cells(spark, both, seed):
    import numpy as np

    x = np.random.default_rng(seed).normal(size=(500, 64))
    vectors = spark.createDataFrame([(i, (r / np.linalg.norm(r)).astype(float).tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>"))
    got, want = both("nearest_by_cells", embeddings=vectors)
    names = ["n_queries", "recall_95", "scans_less"]
    assert dict(zip(names, got[0], strict=True))["recall_95"] and len(want) == 1


def test_many_queries_are_dealt_to_blocks_and_never_joined(spark, monkeypatch):
    from lexmill.operators import ranking, wordindex

    docs = _texts(spark, [f"w{i % 5} w{i % 3} x{i % 7}" for i in range(60)] + [None])
    asked = _items(spark, [f"w{i % 5} x{i % 7} w9" for i in range(9)] + ["..."]).withColumnRenamed("item_id", "query_id")
    scored, any_, every = ranking.bm25(docs, asked), ranking.match(docs, asked, False), ranking.match(docs, asked, True)
    want = [sorted(map(tuple, x.collect())) for x in (any_, every)]
    best = sorted((r[0], r[1], round(r[2], 6)) for r in ranking.best(scored, 3).select("query_id", "doc_id", "score").collect())
    monkeypatch.setattr(wordindex, "MOST_QUERIES", 4)
    for name in ("bm25", "match"):
        monkeypatch.setattr(ranking, name, lambda *a: pytest.fail("a join"))
    assert [sorted(map(tuple, wordindex.match(docs, asked, e).collect())) for e in (False, True)] == want
    assert sorted((r[0], r[1], round(r[2], 6)) for r in wordindex.best(docs, asked, 3).select("query_id", "doc_id", "score").collect()) == best
    told = {r[0]: tuple(r[1:]) for r in wordindex.match_counts(docs, asked).collect()}
    assert told == {q: (sum(a == q for a, _, _ in want[0]), max(n for a, _, n in want[0] if a == q)) for q in told} and len(told) == 9


def test_shared_words_by_tiles(spark, both, monkeypatch):
    from lexmill.operators import wordindex

    monkeypatch.setattr(wordindex, "TILE", 4)
    turns = [(c, t, f"a{(c + t) % 3} b{c % 4} same") for c in range(0, 120, 10) for t in range(4)]
    got, want = both("reminders", conversations=spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1))
    assert got == want and len(got) == 9


def test_a_path_that_all_share_is_met_once(spark, both):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".com/"), F.when(F.col("id") % 3 == 0, "a/b/x.html").when(F.col("id") % 3 == 1, "x.html").otherwise(F.concat(F.lit("a/"), (F.col("id") % 4).cast("string"), F.lit("/b/x.html")))).alias("url"))
    got, want = both("resolved_links", pages=pages)
    assert got == want and got


def test_sums_of_one_form_are_read_once(monkeypatch):
    from lexmill.functions import replies

    read = []
    monkeypatch.setattr(replies.ast, "parse", lambda *a, _parse=replies.ast.parse, **k: read.append(a) or _parse(*a, **k))
    replies._form.cache_clear()
    assert [replies.calculate(f"({a} * 3 - {a}) // (1 + 1) % 97") for a in (5, 80, 120)] == ["5", "80", "23"]
    assert len(read) == 1
    for odd, want in (("3.5 + 1", "4.5"), ("1_0 + 1", "11"), ("1e1", "10.0"), ("0x1f", "31"), ("-7 // 2", "-4"), ("2 - 3 - 4", "-5")):
        assert replies.calculate(odd) == want
    for bad in ("007 + 1", "1 1", "1 / 0", "9 ** 9 ** 9", "+"):
        with pytest.raises(replies.NoSum):
            replies.calculate(bad)


def test_a_document_of_several_rows_counts_once(spark, both):
    texts = [(1, "on air, on"), (1, "On land"), (2, "air"), (2, "air"), (3, None), (4, ""), (None, "air sea"), (5, "sea")]
    got, want = both("postings_df", documents=spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string"))
    assert got == want and len(got) == 4
