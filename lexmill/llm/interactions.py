"""Filter interaction audit by a subset-zeta transform.

Every document has a mask: a bit for each filter that it fails. Documents are
counted by part and mask, and a part's 32 counts are turned, one filter at a
time, into the number of documents that survive every subset of the filters.
A filter that comes after some others removes the difference between two
neighbouring subsets, so all orders, and Shapley sums over them, are read off
one row for each part; no order is run over documents. Counts of documents
with a label are transformed in the same way.

Texts are read once and never shuffled. Copies are found by digest: documents
are counted by digest, part, mask and labels first, so a text that a third of
all rows share is a few rows, of which the smallest id is known.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACES, table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
_ALL = (1 << len(FILTERS)) - 1
_COPY = 1 << FILTERS.index("E")


def failures(text: Column, words: Column) -> Column:
    """The mask of A to D for a text and its split by SPACES (which may begin or end with an empty string)."""
    blank = F.array_contains(words, "").cast("int")
    n, distinct = F.size(words) - F.size(F.filter(words, lambda w: w == "")), F.size(F.array_distinct(words)) - blank
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS))
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and filters failed, and how many of them have quality 1 and toxic 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.split(text, SPACES).alias("words"))
    own = split.select("doc_id", "part", failures(F.col("text"), F.col("words")).alias("fails"), F.sha2("text", 256).alias("digest"))
    marked = labels.groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    known = own.join(marked, "doc_id", "left").fillna(0, ["quality", "toxic"])
    group = ["digest", "part", "fails", "quality", "toxic"]
    each = known.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = each.groupBy(*group).agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("nameless"))
    # a row for each part and label that a text has; rows without an id are no copies
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    free = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("fails").alias("mask"), F.col("free").alias("n")), F.struct(F.col("fails").bitwiseOR(F.lit(_COPY)).alias("mask"), (F.col("n") - F.col("free")).alias("n")))
    cells = copies.withColumn("least", least).withColumn("free", free).select("part", "quality", "toxic", F.explode(both).alias("m")).select("part", "quality", "toxic", "m.*").where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _summed(counts: Column, bit: int) -> Column:
    """A step of the zeta transform: each subset with the bit takes what the one without it has."""
    without = lambda s: F.when(s.bitwiseAND(F.lit(bit)) > 0, F.get(counts, s.bitwiseXOR(F.lit(bit)))).otherwise(F.lit(0))
    return F.transform(counts, lambda x, s: x + without(s))


def survivors(cells: DataFrame) -> DataFrame:
    """part, n, good, toxic: in each array, at subset s of the filters, the documents that fail none of s. One row for each part."""
    cols = {c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(_ALL + 1)]) for c in ("n", "good", "toxic")}
    at = cells.groupBy("part").agg(*[x.alias(c) for c, x in cols.items()])
    for i in range(len(FILTERS)):  # a column for each step, so that no step's expression holds all before it
        at = at.select("part", *[_summed(F.col(c), 1 << i).alias(c) for c in cols])
    # those that fail none of s fail a subset of the others
    return at.select("part", *[F.reverse(c).alias(c) for c in cols])


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit, subset of the filters before it) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append((name, step, 1 << i, before))
            before |= 1 << i
    return out


def _shapley(n: Column, bit: int) -> Column:
    """What a filter removes, summed over all orders: each subset before it comes in as many orders as its own and the others' arrangements."""
    size = len(FILTERS)
    terms = [(factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()), s) for s in range(_ALL + 1) if not s & bit]
    return reduce(lambda a, b: a + b, (F.lit(times) * (F.get(n, F.lit(s)) - F.get(n, F.lit(s | bit))) for times, s in terms))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    A null text is empty; a null lang is the part ''. Repeated rows are
    documents of their own, and copies only of rows with a smaller doc_id; a
    row without an id is no copy. Several labels of one doc_id count as one,
    which is 1 if any is. Columns other than doc_id, text, lang, quality and
    toxic are not read. An empty table gives no rows.
    """
    at = survivors(masks(docs, labels))
    n = F.col("n")
    by_filter = at.select("*", F.array(*[_shapley(n, 1 << i) for i in range(len(FILTERS))]).alias("shapley"))
    steps = F.array(*[F.struct(F.lit(name).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit.bit_length() - 1).alias("f"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for name, step, bit, before in _steps()])
    each = by_filter.select("*", F.explode(steps).alias("s")).select("*", "s.*")
    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    failed = F.get(n, F.lit(0)) - F.get(n, F.col("bit"))
    return each.select(
        "part", "filter_order", "step", F.get(n, after).alias("kept"), lost("n").alias("removed"), (failed - lost("n")).alias("redundant"),
        (F.get(n, F.lit(_ALL).bitwiseXOR(F.col("bit"))) - F.get(n, F.lit(_ALL))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("f")).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order is run over every document.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
f AS (
  SELECT d.r, part, coalesce(q, 0) AS q, coalesce(x, 0) AS x,
         map(['A', 'B', 'C', 'D', 'E'], [
           len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
           100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), regexp_matches(t, '[#$%&*|]'),
           coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)]) AS m
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS c FROM o, range(1, 6) AS g(step)),
run AS (
  SELECT part, s.filter_order, s.step, s.c, q, x, m[s.c] AS fails,
         len(list_filter(string_split(filter_order[1:step - 1], ''), lambda y: y <> '' AND m[y])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: m[y])) AS n_fails
  FROM f, s),
a AS (
  SELECT part, filter_order, step, any_value(c) AS c,
         count_if(NOT gone AND NOT fails) AS kept, count_if(NOT gone AND fails) AS removed, count_if(gone AND fails) AS redundant,
         count_if(fails AND n_fails = 1) AS unique_fails, count_if(NOT gone AND fails AND q = 1) AS good_lost, count_if(NOT gone AND fails AND x = 1) AS toxic_lost
  FROM run GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM a
"""
