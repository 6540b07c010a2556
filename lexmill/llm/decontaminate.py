"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask is a fixed pattern of token positions: ones are hashed, zeros ignored.
Every place of every benchmark item and of every document is hashed under each
mask; equal hashes are hits, also where the ignored tokens differ. At a hit
the document is laid beside the whole item, hits of one such diagonal once, and
a stretch anywhere on it is looked for whose tokens are mostly equal. So a part
of an item, or a passage with some substituted words, is still found and a
chance hit is not.

The hashed items are broadcast only after their rows have been counted and
found under a bound; beyond it the hits come from a shuffled join, whose hot
keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch, table

#: Fixed masks: ones are the hashed positions. However the unequal tokens of a good stretch of 9 to 25 tokens are placed, one of the masks
#: meets equal tokens only, somewhere in it (a test tries all placings).
MASKS = ("110111", "11100011", "1101000011", "11100000101", "10101010001")
LEAST_SPAN, SPAN = min(map(len, MASKS)), max(map(len, MASKS))
#: Least share of equal tokens in a stretch, and least equal tokens.
LEAST_SHARE, LEAST_EQUAL = 0.75, 9
#: Least aligned tokens in a stretch (or all of a shorter item). One of twice that or more can be halved, and a half has the share too, so lengths below suffice.
LEAST_STRETCH = 13
#: Items of fewer tokens than a stretch must have equal, but this many, are looked for word for word.
LEAST_SHORT = 5
#: Seeds that may be broadcast. Token places in a block, more where an item is longer.
MOST_BROADCAST, BLOCK = 200_000, 512


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _blocks(df: DataFrame, carried: str, room: int) -> DataFrame:
    """carried, first, lead, n, b: blocks of n token places, the places from `lead` on in b, with up to `room` tokens on both sides; b begins at token `first`. Needs the array column h.

    A block has max(BLOCK, room) places, so however long a text is, no row
    carries more than three times that.
    """
    fits = F.size("h") - LEAST_SPAN + 1
    places = max(BLOCK, room)

    def block(i: Column) -> Column:
        lead = F.least(i, F.lit(room))
        return F.struct((i - lead).alias("first"), lead.alias("lead"), F.least(F.lit(places), fits - i).alias("n"), F.slice("h", i - lead + 1, lead + places + max(room, SPAN)).alias("b"))

    # no filter on the size: it would move below and cut every text twice
    starts = F.when(fits > 0, F.sequence(F.lit(0), fits - 1, F.lit(places))).otherwise(F.array().cast("array<int>"))
    return df.select(carried, F.explode(F.transform(starts, block)).alias("x")).select(carried, "x.*")


def _places(blocks: DataFrame, *carried: str) -> DataFrame:
    """carried, p, key: a row for each token place and mask that fits, p being the place in block b."""
    at = blocks.select(*carried, "b", F.explode(F.sequence(F.col("lead"), F.col("lead") + F.col("n") - 1)).alias("p"))
    token = lambda k: F.get("b", F.col("p") + k)
    keys = [F.when(token(len(mask) - 1).isNotNull(), F.xxhash64(F.lit(i), *[token(k) for k, bit in enumerate(mask) if bit == "1"])) for i, mask in enumerate(MASKS)]
    return at.select(*carried, "b", "p", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def seeds(items: DataFrame) -> DataFrame:
    """key, item, q of every place q of every item (item, h)."""
    return _places(_blocks(items, "item", 0), "item", "first").select("key", "item", (F.col("first") + F.col("p")).alias("q")).distinct()


def _beside(own: DataFrame) -> Column:
    """A 1 for each token of item h that equals the one beside it in b, else 0, where h[q] is beside b[p]."""
    start = F.col("p") - F.col("q")
    ours = F.slice("b", F.greatest(start, F.lit(0)) + 1, F.size("h") + F.least(start, F.lit(0)))
    theirs = F.slice("h", F.greatest(-start, F.lit(0)) + 1, F.size("h"))
    equal = F.array_join(F.zip_with(ours, theirs, lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    # what is missing where the document begins or ends is unequal
    return F.lpad(equal, F.size("h"), F.lit("0"))


def _stretches(bits: Column, least: Column) -> Column:
    """(share, n_equal) of every stretch of bits that is good."""

    def measured(i: Column, n: Column) -> Column:
        equal = F.length(F.replace(F.substring(bits, i, n), F.lit("0"), F.lit("")))
        return F.struct((equal / n).alias("share"), equal.alias("n_equal"))

    def of(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(bits) - n + 1), lambda i: measured(i, n))

    lengths = F.sequence(least, F.least(2 * least - 1, F.length(bits)))
    every = F.when(F.length(bits) >= least, F.flatten(F.transform(lengths, of)))
    return F.filter(every, lambda x: (x["share"] >= LEAST_SHARE) & (x["n_equal"] >= LEAST_EQUAL))


def hits(docs: DataFrame, benchmark: DataFrame, key: Column, bound: int = MOST_BROADCAST) -> DataFrame:
    """_key, item_id, share, n_equal, n_hits: verified overlaps of each document key and item, with the largest share and number of equal tokens of a good stretch."""
    items = saved(benchmark.select("item_id", _hashed(F.col("text")).alias("h")).distinct().withColumn("item", F.monotonically_increasing_id()))
    room = items.agg(F.max(F.size("h"))).first()[0] or 0
    small = saved(seeds(items))
    blocks = _blocks(docs.select(key.alias("_key"), _hashed(F.col("text")).alias("h")), "_key", room)
    if small.limit(bound + 1).count() <= bound:
        # no more tokens in items that have a seed than about that bound
        seeded = items.join(small.select("item").distinct(), "item", "left_semi")
        own = _places(blocks, "_key").join(F.broadcast(small), "key").join(F.broadcast(seeded), "item")
    else:
        kept = saved(blocks.withColumn("block", F.monotonically_increasing_id()))
        found = _places(kept, "block").drop("b").join(small, "key").select("block", "item", "p", "q")  # blocks are not shuffled with every place
        own = found.join(kept.select("block", "_key", "b"), "block").join(items, "item")
    diagonals = own.select("_key", "item", "item_id", F.size("h").alias("n"), _beside(own).alias("bits")).groupBy("_key", "item", "item_id", "n", "bits").agg(F.count("*").alias("n_hits"))
    # judged inside the aggregate: a filter would move below the merging of hits and be evaluated for each of them
    good = _stretches(F.col("bits"), F.least(F.col("n"), F.lit(LEAST_STRETCH)))
    found = diagonals.groupBy("_key", "item_id").agg(F.max(F.array_max(good["share"])).alias("share"), F.max(F.array_max(good["n_equal"])).alias("n_equal"), F.sum(F.when(F.size(good) > 0, F.col("n_hits"))).alias("n_hits"))
    found = found.where("n_hits > 0")
    short = small_items(items, bound)
    return found if short is None else found.unionByName(verbatim(docs, short, key))


def small_items(items: DataFrame, bound: int) -> DataFrame | None:
    """item_id, h, n, key of the items of LEAST_SHORT tokens or more that have too few for a stretch; None where there are none."""
    short = items.where(F.size("h").between(LEAST_SHORT, LEAST_EQUAL - 1)).select("item_id", "h", F.size("h").alias("n"), F.xxhash64("h").alias("key"))
    n = short.limit(bound + 1).count()
    return None if not n else F.broadcast(short) if n <= bound else short


def verbatim(docs: DataFrame, short: DataFrame, key: Column) -> DataFrame:
    """hits() for short items: places where all their tokens stand side by side."""
    lengths = [r["n"] for r in short.select("n").distinct().collect()]  # numbers below LEAST_EQUAL
    h = docs.select(key.alias("_key"), _hashed(F.col("text")).alias("h"))

    def runs(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size("h") - n + 1), lambda i: F.slice("h", i, F.lit(n)))
        return F.when(F.size("h") >= n, all_).otherwise(F.array().cast("array<array<bigint>>"))

    each = h.select("_key", F.explode(F.concat(*map(runs, lengths))).alias("own")).withColumn("key", F.xxhash64("own"))
    found = each.join(short, "key").where(F.col("own") == F.col("h"))
    return found.groupBy("_key", "item_id").agg(F.lit(1.0).alias("share"), F.max("n").alias("n_equal"), F.count("*").alias("n_hits"))


def _by_id() -> Column:
    """The document's id; for rows without one a digest of the text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share, n_equal, n_hits: one row per document id and benchmark item that it holds.

    Null and blank texts, on either side, overlap nothing. Items of fewer than
    LEAST_EQUAL tokens must be held word for word; those of fewer than
    LEAST_SHORT are no passages and are not looked for. Repeated rows of one doc_id
    count as one document; all rows without an id come under a null doc_id.
    Columns other than doc_id, text and item_id are not read; empty tables
    give no rows.
    """
    with scratch(docs.sparkSession):
        return saved(hits(docs, benchmark, F.col("doc_id")).withColumnRenamed("_key", "doc_id"), outlives=True)


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns unchanged; rows without an id are judged by their own text."""
    with scratch(docs.sparkSession):
        bad = saved(hits(docs.select("doc_id", "text"), benchmark, _by_id()).select("_key").distinct(), outlives=True)
    # the row travels as one column, so no name of its own can clash
    rows = docs.select(_by_id().alias("_key"), F.struct(*docs.columns).alias("_row"))
    return rows.join(bad, "_key", "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
