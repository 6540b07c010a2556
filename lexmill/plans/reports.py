"""Evaluation reports, lookups and text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue, memory, ranking, reports
from . import search
from .registry import query, table


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers: category is the priority; the flags come from the status and the price."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    found = reports.outcome(F.col("o_orderstatus") != "O", cents % 3, F.least(cents % 3, cents % 2), F.least(cents % 3, cents % 4), F.when(cents % 5 == 0, "yes").when(cents % 5 == 1, "no").otherwise("unsure"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), found.alias("f"), F.when(cents % 7 == 0, "timeout").alias("error"), F.col("o_totalprice").alias("seconds")).select("category", "f.*", "error", "seconds")


@query("""WITH c AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS x FROM orders),
a AS (SELECT o_orderpriority AS category, o_orderstatus <> 'O' AS searched, least(x % 3, x % 2) / nullif(x % 3, 0) AS shown, least(x % 3, x % 4) / nullif(x % 3, 0) AS cited, CASE x % 5 WHEN 0 THEN true WHEN 1 THEN false END AS supported, x % 7 = 0 AS failed, o_totalprice AS seconds FROM c)
SELECT category, grouping(category) > 0 AS overall, count(*) AS n, round(avg(CAST(searched AS INT)), 6) AS searched, round(avg(shown), 6) AS shown_recall, round(avg(cited), 6) AS cited_recall, round(avg(CAST(supported AS INT)), 6) AS supported,
  count(*) FILTER (failed) AS errors, median(seconds) AS s_median, percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds) AS s_p95 FROM a GROUP BY GROUPING SETS ((category), ())""")
def outcome_report(spark: SparkSession, d: str) -> DataFrame:
    out = reports.outcome_report(_answers(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c in ("searched", "shown_recall", "cited_recall", "supported") else c for c in out.columns])


@query(f"""WITH {search.BM25}, {search.first('scores', search.LIMIT)}, {search.GOLD}, tops AS (SELECT query_id, max(score) AS top_score FROM ranked GROUP BY ALL),
per AS (SELECT query_id, count(*) FILTER (rank <= 1) AS n1, count(*) FILTER (rank <= 5) AS n5, count(*) AS n10, min(rank) AS f, sum(1.0 / log2(rank + 1.0)) AS gain FROM hit GROUP BY ALL),
own AS (SELECT item_id % 3 AS category, CASE WHEN golds IS NOT NULL THEN coalesce(n1, 0) / golds END AS r1, CASE WHEN golds IS NOT NULL THEN coalesce(n5, 0) / golds END AS r5, CASE WHEN golds IS NOT NULL THEN coalesce(n10, 0) / golds END AS r10,
  CASE WHEN golds IS NOT NULL THEN coalesce(1.0 / f, 0) END AS rr, CASE WHEN golds IS NOT NULL THEN coalesce(gain, 0) / list_sum(list_transform(range(1, least(10, golds) + 1), lambda i: 1.0 / log2(i + 1.0))) END AS ndcg, coalesce(top_score, 0) AS top_score
  FROM benchmark b LEFT JOIN golds g ON g.query_id = b.item_id LEFT JOIN per p ON p.query_id = b.item_id LEFT JOIN tops t ON t.query_id = b.item_id)
SELECT category, grouping(category) > 0 AS overall, count(*) AS n, count(r1) AS answerable, round(avg(r1), 5) AS recall_at_1, round(avg(r5), 5) AS recall_at_5, round(avg(r10), 5) AS recall_at_10, round(avg(rr), 5) AS reciprocal_rank, round(avg(ndcg), 5) AS ndcg, round(avg(top_score), 4) AS top_score
FROM own GROUP BY GROUPING SETS ((category), ())""")
def rank_report(spark: SparkSession, d: str) -> DataFrame:
    """Word search's measures per category of questions and overall."""
    found = ranking.settled(search.bm25_topk(spark, d))
    own = search.measured(spark, d, found)
    tops = found.groupBy("query_id").agg(F.max("score").alias("top_score"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("category"))
    out = reports.rank_report(asked.join(own, "query_id", "left").join(tops, "query_id", "left"))
    digits = {"top_score": 4} | {c: 5 for c in ("recall_at_1", "recall_at_5", "recall_at_10", "reciprocal_rank", "ndcg")}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


LINES = [5.0, 15.0, 30.0, 60.0]


@query("""SELECT event_type, line, count(*) FILTER (value >= line) AS kept, count(*) FILTER (value >= line AND user_id % 2 = 0) AS right,
  round(count(*) FILTER (value >= line AND user_id % 2 = 0) / nullif(count(*) FILTER (value >= line), 0), 6) AS precision, round(count(*) FILTER (value >= line AND user_id % 2 = 0) / nullif(count(*) FILTER (user_id % 2 = 0), 0), 6) AS recall
FROM events, (VALUES (5.0::DOUBLE), (15.0::DOUBLE), (30.0::DOUBLE), (60.0::DOUBLE)) AS l(line) GROUP BY event_type, line""")
def line_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of events of even users at several lines of the value."""
    rows = table(spark, d, "events").select("event_type", F.col("value").alias("score"), (F.col("user_id") % 2 == 0).alias("good"))
    return reports.at_lines(rows, LINES, ["event_type"]).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("""SELECT line, round(avg(CAST(coalesce(CASE WHEN event_type = 'purchase' THEN value END, -1e300) >= line AS INT)), 6) AS right, round(avg(CAST(coalesce(CASE WHEN event_type <> 'purchase' THEN value END, -1e300) >= line AS INT)), 6) AS other
FROM events, (VALUES (5.0::DOUBLE), (15.0::DOUBLE), (30.0::DOUBLE), (60.0::DOUBLE)) AS l(line) GROUP BY line""")
def floor_shares(spark: SparkSession, d: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    rows = table(spark, d, "events").select(F.when(bought, F.col("value")).alias("right"), F.when(~bought, F.col("value")).alias("other"))
    return reports.reaching(rows, LINES, "right", "other").select("line", F.round("right", 6).alias("right"), F.round("other", 6).alias("other"))


@query("""SELECT o_orderpriority, round(min(o_totalprice), 2) AS least, round(median(o_totalprice), 2) AS median, round(max(o_totalprice), 2) AS most FROM orders GROUP BY ALL""")
def price_spread(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*reports.spread("o_totalprice"))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
c AS (SELECT *, greatest(1, least((19 * (n + 1)) // 20, n - 1)) AS low FROM o)
SELECT event_type, n, CASE WHEN n > 1 THEN round(sum(CASE WHEN place = low THEN value * (20 - (19 * (n + 1) - low * 20)) ELSE value * (19 * (n + 1) - low * 20) END) / 20, 6) END AS quantile FROM c WHERE place BETWEEN low AND low + 1 GROUP BY event_type, n""")
def p95_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return reports.exclusive_quantile(table(spark, d, "events"), ["event_type"], "value", 19, 20).withColumn("quantile", F.round("quantile", 6))


@query()
def answer_errors(spark: SparkSession, d: str) -> DataFrame:
    """Token edits between each question and its answer, per turn. DuckDB's levenshtein compares bytes; tested against brute force."""
    pairs = memory.exchanges(table(spark, d, "conversations")).where("answer is not null").select("turn", T.terms(F.col("question")).alias("expected"), T.terms(F.col("answer")).alias("said"))
    return reports.error_rates(pairs, ["turn"])


@query("""SELECT c_mktsegment, round(least(greatest(sum(c_acctbal * w) / nullif(sum(w), 0), min(CASE WHEN w > 0 THEN c_acctbal END)), max(CASE WHEN w > 0 THEN c_acctbal END)), 4) AS mean FROM (SELECT *, CAST(c_nationkey % 5 AS DOUBLE) AS w FROM customer) GROUP BY ALL""")
def trait_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("w", (F.col("c_nationkey") % 5).cast("double"))
    return rows.groupBy("c_mktsegment").agg(F.round(reports.weighted_mean("c_acctbal", "w"), 4).alias("mean"))


@query(f"""WITH t AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '{search.TERM}') AS t FROM conversations),
uni AS (SELECT x AS token, count(*) AS n FROM (SELECT unnest(t) AS x FROM t) GROUP BY ALL), u AS (SELECT sum(n) AS total, count(*) AS kinds FROM uni),
p1 AS (SELECT token, n, (n + 1.0::DOUBLE) / (total + kinds) AS p FROM uni, u),
bi AS (SELECT t[i] AS history, t[i + 1] AS token, count(*) AS n FROM t, range(1, 5000) AS r(i) WHERE i < len(t) GROUP BY ALL), h AS (SELECT history, sum(n) AS total, count(*) AS kinds FROM bi GROUP BY ALL)
SELECT '' AS history, token, n, round(p, 9) AS probability FROM p1 UNION ALL
SELECT history, token, bi.n, round((bi.n + kinds * p) / (total + kinds), 9) FROM bi JOIN h USING (history) JOIN p1 USING (token)""")
def ngram_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Witten-Bell probabilities of words and pairs of words in conversations."""
    out = reports.ngram_probabilities(table(spark, d, "conversations").select(T.terms(F.col("text")).alias("tokens")), 2)
    return out.select(F.array_join("history", " ").alias("history"), "token", "n", F.round("probability", 9).alias("probability"))


@query()
def folds(spark: SparkSession, d: str) -> DataFrame:
    """The fold of each distinct term: a keyed digest, which SQL does not have; tested on fixed values."""
    words = table(spark, d, "documents").select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    return words.select("term", reports.fold_of("term").alias("fold"))


@query("""WITH m AS (SELECT conv_id, turn, role, text AS question, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT conv_id, turn, question, answer, sha256(CAST(to_json(string_split(answer, chr(10))) AS VARCHAR)) AS passages_sha256 FROM m WHERE role = 'user' AND answer IS NOT NULL),
v AS (SELECT DISTINCT question, answer, passages_sha256, length(answer) % 2 = 0 AS verdict FROM a WHERE length(question) % 3 <> 0)
SELECT conv_id, turn, a.passages_sha256, verdict FROM a LEFT JOIN v ON v.question = a.question AND v.answer = a.answer AND v.passages_sha256 = a.passages_sha256""")
def verdict_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that are held for an answer, by question, answer and digest of the passages."""
    each = memory.exchanges(table(spark, d, "conversations")).where("answer is not null").withColumn("passages", F.split("answer", "\n"))
    keyed = each.select("conv_id", "turn", *reports.passages_key("question", "answer", "passages"))
    held = keyed.where(F.length("question") % 3 != 0).select("question", "answer", "passages_sha256", (F.length("answer") % 2 == 0).alias("verdict")).distinct()
    return keyed.join(held, ["question", "answer", "passages_sha256"], "left").select("conv_id", "turn", "passages_sha256", "verdict")


@query(r"""WITH w AS (SELECT DISTINCT lower(x) AS word FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+(''s)?')) AS x FROM conversations)), dict AS (SELECT DISTINCT x AS word, length(x) AS phones FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS x FROM benchmark))
SELECT w.word, CASE WHEN k.word IS NOT NULL THEN 'known' WHEN p.word IS NOT NULL THEN 'possessive' ELSE 'guessed' END AS how, coalesce(k.phones, p.phones + 1, length(w.word) * 10) AS phones FROM w LEFT JOIN dict k ON k.word = w.word LEFT JOIN dict p ON w.word LIKE '%''s' AND p.word = w.word[:-3]""")
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Words of conversations in a dictionary of the benchmark's; a word's length stands for its phones."""
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+(?:'s)?"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    known = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).distinct().withColumn("phones", F.length("word"))
    return catalogue.looked_up(words, known, "word", "phones", lambda x: x + 1, lambda w: F.length(w) * 10)


@query(f"""WITH f AS (SELECT unnest(regexp_extract_all(replace(strip_accents(lower(coalesce(text, ''))), 'ß', 'ss'), '{search.TERM}')) AS term FROM documents) SELECT term, count(*) AS n FROM f GROUP BY ALL""")
def folded_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(T.folded_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, length(left(text, 2000)) AS kept, length(text) AS n_chars, md5(CASE WHEN source = 'src1' THEN text ELSE lang || ' ' || source || chr(10) || text END) AS indexed_md5 FROM documents""")
def clips(spark: SparkSession, d: str) -> DataFrame:
    """Texts clipped for a trace, and what is searched of them under a header."""
    header = F.when(F.col("source") != "src1", F.concat_ws(" ", "lang", "source"))
    clip = T.clipped(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(clip["text"]).cast("long").alias("kept"), clip["length"].cast("long").alias("n_chars"), F.md5(T.indexed(header, F.col("text"))).alias("indexed_md5"))


@query(r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS i FROM conversations), f AS (SELECT conv_id, turn, w, min(i) AS i FROM t GROUP BY ALL)
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY ALL""")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's words once, in the order in which they are first said."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(T.terms(F.col("text"))), " ").alias("words")).where("words <> ''")


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts >= timezone('UTC', timezone('Europe/Berlin', TIMESTAMP '2024-01-10 00:00:00')) AND ts < timezone('UTC', timezone('Europe/Berlin', TIMESTAMP '2024-01-13 00:00:00')) GROUP BY ALL""")
def day_range(spark: SparkSession, d: str) -> DataFrame:
    """Events of three local days of a zone."""
    since, until = memory.day_range("2024-01-10", "2024-01-12", "Europe/Berlin")
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").where((at >= since) & (at < until)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS turn, count(l_orderkey) AS n_calls, string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS calls FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def turn_calls(spark: SparkSession, d: str) -> DataFrame:
    """Orders as turns, their lines as the calls made in them."""
    turns = table(spark, d, "orders").select(F.col("o_orderkey").alias("turn"))
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("turn"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("position"), F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag").alias("call"))
    nested = memory.with_calls(turns, calls, "turn", "position")
    return nested.select("turn", F.size("calls").cast("long").alias("n_calls"), F.when(F.size("calls") > 0, F.array_join(F.transform("calls", lambda c: c["call"]), ",")).alias("calls"))


@query("""SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position, o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 50 = 0""")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as passages, customers as their documents, nations as sources, in the order of a list of ids."""
    from pyspark.sql.window import Window as W

    orders = table(spark, d, "orders")
    wanted = orders.where("o_orderkey % 50 = 0").select("o_orderkey", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("position"))
    chunks = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    documents = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return catalogue.chunk_rows(wanted, chunks, documents, table(spark, d, "nation").select("n_nationkey", "n_name"), "o_orderkey", "c_custkey", "n_nationkey").select("position", "o_orderkey", "c_name", "n_name")


@query("""WITH held AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE vec_id % 3 <> 0), new AS (SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS x FROM embeddings WHERE vec_id % 2 = 0), parents AS (SELECT vec_id FROM embeddings WHERE label <> 1)
SELECT vec_id, round(x, 6) AS x FROM held WHERE vec_id NOT IN (SELECT vec_id FROM new JOIN parents USING (vec_id)) UNION ALL SELECT vec_id, round(x, 6) FROM new JOIN parents USING (vec_id)""")
def vectors_put(spark: SparkSession, d: str) -> DataFrame:
    """New vectors take the place of held ones where their parent is still there."""
    v = table(spark, d, "embeddings")
    held = v.where("vec_id % 3 <> 0").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    new = v.where("vec_id % 2 = 0").select("vec_id", F.get("embedding", F.lit(1)).cast("double").alias("x"))
    return catalogue.put(held, new, v.where("label <> 1").select("vec_id"), ["vec_id"]).withColumn("x", F.round("x", 6))


@query(r"""WITH p AS (SELECT doc_id, lang, source, text, len(regexp_split_to_array(text, '\r\n|[\r\n]')) AS lines, length(left(text, 2400)) - instr(reverse(left(text, 2400)), chr(10)) AS back, lead(lang) OVER w AS l1, lead(lang, 2) OVER w AS l2 FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
r AS (SELECT doc_id, '[' || source || '/' || doc_id || '.md:1' || CASE WHEN lines > 1 THEN '-' || lines ELSE '' END || '] ' || lang || chr(10) || CASE WHEN length(text) <= 2400 THEN text WHEN instr(left(text, 2400), chr(10)) > 0 AND back >= 1200 THEN left(text, back) ELSE left(text, 2400) END
  || CASE WHEN l1 IS NULL THEN '' ELSE chr(10) || 'Links to: ' || l1 || CASE WHEN l2 IS NULL OR l2 = l1 THEN '' ELSE ', ' || l2 END END AS shown FROM p)
SELECT doc_id, md5(shown) AS shown_md5, length(shown) AS n FROM r WHERE shown IS NOT NULL""")
def rendered_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages as a tool shows them: citation and heading, the cut body, the titles it links to."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("source").orderBy("doc_id")
    p = table(spark, d, "documents").withColumn("targets", F.array_compact(F.array(F.lead("lang").over(w), F.lead("lang", 2).over(w))))
    cited = T.citation(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")), F.lit(1), F.size(T.lines(F.col("text"))))
    shown = T.rendered(cited, F.col("lang"), F.col("text"), F.col("targets"))
    return p.select("doc_id", F.md5(shown).alias("shown_md5"), F.length(shown).cast("long").alias("n")).where("shown_md5 is not null")


@query(f"WITH {search.BM25} SELECT query_id, rank, doc_id, score FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM scores) WHERE rank <= 10")
def bm25_newest(spark: SparkSession, d: str) -> DataFrame:
    """Word search where ties go to the newest, that is the largest id."""
    return search.words(spark, d, search.LIMIT, newest=True)


@query(f"WITH {search.COSINES} SELECT query_id, vec_id, cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM cosines) WHERE place <= 5")
def closest_facts(spark: SparkSession, d: str) -> DataFrame:
    """The five closest of the held, by id where they tie."""
    near = search.nearest_k_with_ties(spark, d)
    from pyspark.sql.window import Window as W

    return near.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where("place <= 5").drop("rank")


@query("""SELECT user_id AS owner, event_id AS fact_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events""")
def facts_order(spark: SparkSession, d: str) -> DataFrame:
    """Facts of an owner, the newest first."""
    facts = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("fact_id"), F.col("ts").alias("since"))
    return memory.newest_first(facts).select("owner", "fact_id", "place")


FUSED_MEMORY = search.FUSED.replace(f"{search.WEIGHT} * coalesce", "0.1 * coalesce")


@query(f"WITH {FUSED_MEMORY} SELECT query_id, rank, doc_id, score FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM fused WHERE score >= 0.25) WHERE rank <= 10")
def recall_fused(spark: SparkSession, d: str) -> DataFrame:
    """Documents as past turns, found by words and meaning together above a floor; ties go to the newest."""
    turns = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("at"), "text")
    v = table(spark, d, "embeddings")
    asked = v.join(table(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "text", "embedding")
    held = v.join(turns, F.col("vec_id") == F.col("doc_id"), "left_semi")
    return search.searching.recall(turns, asked, 10, at_least=0.25, vectors_of=held)


@query(f"""WITH {search.BM25}, {search.first('scores', search.DEPTH, 'words')}, m AS (SELECT w.*, source IN ('src0', 'src1', 'src2') AS confined FROM words w JOIN documents USING (doc_id))
SELECT query_id, place, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM m WHERE NOT confined) WHERE place <= 3""")
def surfaced_turns(spark: SparkSession, d: str) -> DataFrame:
    """The first three hits of each question that do not confine the reader."""
    top = search.words(spark, d, search.DEPTH).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return ranking.surfaced(top, F.col("source").isin("src0", "src1", "src2"), 3, keep=False).select("query_id", "place", "doc_id")


@query(f"""WITH {search.BM25}, {search.first('scores', search.LIMIT, 'words')} SELECT query_id, count(*) FILTER (source NOT IN ('src0', 'src1', 'src2')) AS shown, count(*) FILTER (source IN ('src0', 'src1', 'src2')) AS withheld FROM words JOIN documents USING (doc_id) GROUP BY ALL""")
def withheld_counts(spark: SparkSession, d: str) -> DataFrame:
    top = search.words(spark, d, search.LIMIT).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return ranking.withheld_after(top, F.col("source").isin("src0", "src1", "src2"), search.LIMIT)


@query(f"""WITH {FUSED_MEMORY}, f AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM fused WHERE score >= 0.25),
o AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f JOIN documents USING (doc_id) WHERE rank <= 50 AND source IS DISTINCT FROM 'src' || (query_id % 20))
SELECT query_id, place, doc_id, score FROM o WHERE place <= 3""")
def reminders_fused(spark: SparkSession, d: str) -> DataFrame:
    """Documents as turns of the conversation that their source names: what others hold close to a question, by words and meaning, above a floor."""
    docs = table(spark, d, "documents")
    v = table(spark, d, "embeddings")
    asked = v.join(table(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "text", "embedding")
    turns = docs.select("doc_id", F.col("doc_id").alias("at"), "text")
    found = search.searching.recall(turns, asked, 50, at_least=0.25, vectors_of=v.join(turns, F.col("vec_id") == F.col("doc_id"), "left_semi"))
    named = found.join(docs.select("doc_id", F.col("source").alias("said_in")), "doc_id").withColumn("asked_in", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return ranking.reminded(named, 0.25)


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events")
def canonical_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.canonical_json(F.col("props")).alias("props"))


@query("""WITH e AS (SELECT user_id, event_id, event_type AS path, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 4 AS INT) END AS page, CAST(floor(value) AS INT) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events)
SELECT g.user_id AS query_id, g.event_id AS gold_id, min(r.rank) AS rank FROM e g JOIN e r ON r.user_id = g.user_id AND r.path = g.path AND r.page IS NOT DISTINCT FROM g.page AND r.rank <= 10 AND r.x <= g.x + 8 AND g.x + 3 <= r.x + 5 WHERE g.event_id % 3 = 0 GROUP BY ALL""")
def span_hits(spark: SparkSession, d: str) -> DataFrame:
    """Events as spans of lines of their type: where a user's first ten passages meet the labelled ones."""
    from pyspark.sql.window import Window as W

    from ..operators import evaluation

    page = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 4).cast("int")).alias("page")
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("event_type").alias("path"), page, F.floor("value").cast("int").alias("x"))
    ranked = e.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("event_id"))).where("rank <= 10").select("query_id", "rank", "path", "page", F.col("x").alias("start"), (F.col("x") + 5).alias("end"))
    gold = e.where("event_id % 3 = 0").select("query_id", F.col("event_id").alias("gold_id"), "path", "page", (F.col("x") + 3).alias("start"), (F.col("x") + 8).alias("end"))
    return evaluation.hits(ranked, gold)
