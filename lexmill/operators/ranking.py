"""Word search, fusion and merging of rankings, over many queries in one plan.

Documents are (doc_id, text), queries (query_id, text). Rankings are
(query_id, doc_id, score); ties go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stemming import stems_of
from ..functions.text import folded_terms, terms
from .common import settled, small

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Digits to which scores are compared.
DIGITS = 6
#: Cuts a text to an array of terms.
Analyser = Callable[[Column], Column]


def query_terms(queries: DataFrame, analyse: Analyser = terms) -> DataFrame:
    """query_id, term, qtf: a repeated query term counts again."""
    return queries.select("query_id", F.explode(analyse(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


#: Stands for a document itself among its postings; no term is empty.
_WHOLE = ""


def postings(docs: DataFrame, vocabulary: DataFrame | None = None, analyse: Analyser = terms) -> DataFrame:
    """doc_id, term, f, len; only terms of `vocabulary` (term) where it is given. Terms are filtered before they are shuffled."""
    split = docs.select("doc_id", analyse(F.col("text")).alias("t"))  # once for each text, not for each term
    each = split.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term"))
    if vocabulary is not None:
        each = each.join(small(vocabulary.select("term").distinct()), "term", "left_semi")
    return each.groupBy("doc_id", "term", "len").agg(F.count("*").alias("f"))


def term_counts(docs: DataFrame, analyse: Analyser = terms) -> DataFrame:
    """term, n_docs, n: the distinct documents that hold a term, and its places. A document of several rows counts once, one without a doc_id not at all.

    Terms are sorted inside their row, so that the first place of each is known
    there, and tasks sum by term; only documents of several rows are told apart
    by a shuffle.
    """
    several = small(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several")))
    again = F.when(F.col("several"), F.col("doc_id"))
    split = docs.select("doc_id", "text").join(several, "doc_id", "left").select(again.alias("again"), (F.col("doc_id").isNotNull() & F.col("several").isNull()).alias("once"), F.sort_array(analyse(F.col("text"))).alias("term"))
    beside = F.arrays_zip("term", F.concat(F.array(F.lit(_WHOLE)), F.col("term")).alias("before"))  # one longer than the terms
    each = split.select("again", "once", F.inline(beside)).where("term is not null")
    n_docs = F.sum((F.col("once") & (F.col("term") != F.col("before"))).cast("long")) + F.count_distinct("again")
    return each.groupBy("term").agg(n_docs.alias("n_docs"), F.count("*").alias("n"))


def indexed(docs: DataFrame, vocabulary: DataFrame | None = None, analyse: Analyser = terms) -> DataFrame:
    """postings() and, under the empty term, a row for each document, so that one pass over the texts gives counts and lengths too."""
    marked = vocabulary.select("term").union(vocabulary.sparkSession.createDataFrame([(_WHOLE,)], "term string")) if vocabulary is not None else None
    return postings(docs, marked, lambda text: F.concat(analyse(text), F.array(F.lit(_WHOLE)))).withColumn("len", F.col("len") - 1)


def reindexed(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None, analyse: Analyser = terms) -> DataFrame:
    """An index after documents were added or replaced (`changed`: doc_id, text) and removed (doc_id); only changed texts are read."""
    gone = changed.select("doc_id") if removed is None else changed.select("doc_id").union(removed.select("doc_id"))
    return index.join(small(gone.distinct()), "doc_id", "left_anti").unionByName(indexed(changed, analyse=analyse))


def idf(n_docs: Column, n: Column) -> Column:
    raw = F.log((n_docs - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def bm25(docs: DataFrame, queries: DataFrame, within: DataFrame | None = None, analyse: Analyser = terms) -> DataFrame:
    """query_id, doc_id, score of every document that holds a query term.

    Document counts, frequencies and the average length are those of all
    `docs`, also where `within` (doc_id) says which may be found.
    """
    asked = settled(query_terms(queries, analyse))
    return bm25_of(settled(indexed(docs, asked, analyse)), asked, within)


def bm25_of(index: DataFrame, asked: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """bm25 of query_terms() over an index that holds at least their terms."""
    tf = index.where(F.col("term") != _WHOLE)
    stats = index.where(F.col("term") == _WHOLE).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    weights = tf.groupBy("term").agg(F.count("*").alias("n")).join(F.broadcast(stats))  # one row of totals
    weights = weights.select("term", idf(F.col("n_docs"), F.col("n")).alias("idf"), "avg_len")
    if within is not None:
        tf = tf.join(within.select("doc_id"), "doc_id", "left_semi")
    weighted = asked.join(weights, "term")
    part = F.col("qtf") * F.col("idf") * (F.col("f") * (K1 + 1)) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return tf.join(small(weighted), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def stemmed_bm25(docs: DataFrame, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """bm25 over stems of folded terms, so that inflected and accented forms match. Each distinct term is stemmed once."""
    asked = query_terms(queries, folded_terms)
    wanted = asked.join(stems_of(asked), "term").groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("qtf").alias("qtf"))
    wanted = settled(wanted)
    spoken = docs.select(F.explode(folded_terms(F.col("text"))).alias("term"))
    forms = settled(stems_of(spoken).join(small(wanted.select(F.col("term").alias("stem")).distinct()), "stem", "left_semi"))
    raw = indexed(docs, forms, folded_terms)
    named = raw.join(small(forms), "term", "left").withColumn("term", F.coalesce("stem", "term"))
    return bm25_of(settled(named.groupBy("doc_id", "term", "len").agg(F.sum("f").alias("f"))), wanted, within)


def best(scores: DataFrame, limit: int, *more: str, newest: bool = False) -> DataFrame:
    """The first `limit` of each query: query_id, rank, doc_id, score (rounded); ties go to the smaller doc_id, or to the larger if `newest`."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id") if newest else F.asc("doc_id"))
    rounded = scores.withColumn("score", F.round("score", DIGITS))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score", *more)


def match(docs: DataFrame, queries: DataFrame, every: bool) -> DataFrame:
    """query_id, doc_id, n_terms: documents with any (or every) distinct query term."""
    q = query_terms(queries).select("query_id", "term")
    sizes = q.groupBy("query_id").agg(F.count("*").alias("size"))
    hit = postings(docs, q).join(small(q), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n_terms"))
    return hit.join(small(sizes), "query_id").where("n_terms = size").drop("size") if every else hit


def phrase(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, n: places where a query's terms stand side by side in order.

    The first term's places are the candidates; the terms after them are compared in place.
    """
    q = queries.select("query_id", terms(F.col("text")).alias("q")).where(F.size("q") > 0)
    q = small(q.select("query_id", "q", F.get("q", F.lit(0)).alias("term"), F.size("q").alias("n")))
    d = settled(docs.select("doc_id", terms(F.col("text")).alias("d")))
    # narrow rows first: a document's terms come back once for each query whose first term it has
    at = d.select("doc_id", F.posexplode("d").alias("at", "term")).join(q.select("query_id", "term"), "term").groupBy("doc_id", "query_id").agg(F.collect_list("at").alias("at"))
    met = at.join(d, "doc_id").join(q, "query_id")
    n = F.size(F.filter("at", lambda i: F.slice("d", i + 1, F.col("n")) == F.col("q"))).cast("long")
    return met.select("query_id", "doc_id", n.alias("n")).where("n > 0")


def word_scale(n_docs: Column) -> Column:
    """The scale that makes a word score comparable with a cosine."""
    return F.log(2 * n_docs + 1) * (K1 + 1)


def fused(similar: DataFrame, words: DataFrame, n_docs: int, weight: float) -> DataFrame:
    """cosine + weight x scaled word score; a missing side counts 0. Both are (query_id, doc_id, score)."""
    a, b = similar.withColumnRenamed("score", "cosine"), words.withColumnRenamed("score", "word")
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", (F.coalesce("cosine", F.lit(0.0)) + weight * F.coalesce("word", F.lit(0.0)) / word_scale(F.lit(float(n_docs)))).alias("score"))


def merged_best(rankings: list[DataFrame]) -> DataFrame:
    """Each document's largest score over several rankings."""
    return reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "score") for r in rankings]).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def merged_reciprocal(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over several rankings that have a rank."""
    all_ = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in rankings])
    # the parts are summed in order of size, so the sum does not depend on the partitions
    parts = all_.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(1.0 / (k + F.col("rank")))).alias("parts"))
    return parts.select("query_id", "doc_id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x).alias("score"))


def hopped(scores: DataFrame, links: DataFrame, hops: int, weight: float, seeds: int = 5) -> DataFrame:
    """Scores after following links (doc_id, to): a reached document gets its own score plus weight x its best seed's, if that is more.

    The next seeds are the best of those just reached.
    """
    own = settled(scores.select("query_id", "doc_id", "score"))
    now, front = own, best(own, seeds).select("query_id", "doc_id", "score")
    for _ in range(hops):
        gained = front.join(links.select("doc_id", "to"), "doc_id").where("to <> doc_id").groupBy("query_id", F.col("to").alias("doc_id")).agg(F.max("score").alias("gain"))
        reached = gained.join(own, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) + weight * F.col("gain")).alias("score"))
        now = settled(merged_best([now, reached]))
        front = best(now.join(gained.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"), seeds).select("query_id", "doc_id", "score")
    return now


def reranked(ranking: DataFrame, judge: DataFrame, top: int) -> DataFrame:
    """The first `top` by the judge's (query_id, doc_id, judged), ties by the old rank; the others stay behind."""
    j = ranking.join(judge, ["query_id", "doc_id"], "left").withColumn("late", F.col("rank") > top)
    order = W.partitionBy("query_id").orderBy("late", F.when(~F.col("late"), -F.coalesce("judged", F.lit(0.0))), "rank")
    return j.withColumn("new_rank", F.row_number().over(order)).select("query_id", "doc_id", "new_rank", "rank", "score", "judged")


def shown(ranking: DataFrame, private: Column, limit: int) -> DataFrame:
    """The first `limit` rows that are not private, each with `withheld`: private rows among the query's first `limit`."""
    by = W.partitionBy("query_id")
    marked = ranking.withColumn("private", private).withColumn("withheld", F.sum(F.when(F.col("private") & (F.col("rank") <= limit), 1).otherwise(0)).over(by))
    order = by.orderBy("rank")
    return marked.where(~F.col("private")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "place", "doc_id", "score", "withheld")


def surfaced(ranking: DataFrame, confined: Column, limit: int, keep: bool) -> DataFrame:
    """The first `limit` rows of each query as they may be shown: with `keep`, all of them, `confines` telling those that confine the reader; else those not confined, which then move up."""
    marked = ranking.withColumn("confines", confined)
    shown_ = marked if keep else marked.where(~F.col("confines"))
    order = W.partitionBy("query_id").orderBy("rank")
    return shown_.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def withheld_after(ranking: DataFrame, confined: Column, limit: int) -> DataFrame:
    """query_id, shown, withheld: of each query's first `limit` rows, those that may be shown and those that are held back; none move up."""
    first = ranking.where(F.col("rank") <= limit).withColumn("_held", confined)
    return first.groupBy("query_id").agg(F.count_if(~F.col("_held")).alias("shown"), F.count_if("_held").alias("withheld"))


def reminded(found: DataFrame, floor: float, most: int = 3) -> DataFrame:
    """query_id, place, doc_id, score: of found turns (query_id, asked_in, said_in, doc_id, rank, score) the first `most` that reach the floor and were said elsewhere."""
    others = found.where((F.col("score") >= floor) & ~F.col("asked_in").eqNullSafe(F.col("said_in")))
    order = W.partitionBy("query_id").orderBy("rank")
    return others.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "place", "doc_id", "score")
