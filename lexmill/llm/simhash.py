"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most `distance` bits agree, in one
of `distance // 2 + 1` segments, in all bits but one at most. So each
fingerprint is indexed once per bit with that bit's segment kept and the bit
itself struck out (a one-wildcard variant); equal variants are the candidates,
and the full distance is verified.

A bucket of equal variants may hold a third of the table, so its pairs are
never written out. A bucket of two is a pair already when it has been counted.
Each larger one names a few leads, with which all members are compared; where
those leave one member at most, that is every pair. What links makes partial
components. In each of the other buckets the members outside its largest
component are then compared with the rest, so no pair inside one component is
looked at again, and no link between components is lost.

Buckets are counted and joined, never held by one task: the small side of each
join on a variant is a written table, so adaptive execution can split a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, partitions, saved, scratch, table
from .graph import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints drawn from a bucket, besides its smallest and largest, to be compared with all others of it; buckets of three or more that may be broadcast.
DRAWN, MOST_BROADCAST = 3, 200_000
_STEP = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the k-word shingles of a text; 0 for null or no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    flat, n = b" ".join(words), max(1, len(words) - k + 1)
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        h = np.fromiter((hashed(flat[s : e - 1], SEED) for s, e in zip(starts[at : min(n, at + _STEP)], ends[min(k, len(words)) - 1 + at :], strict=False)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every whole text."""

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        for r in each:
            yield r["doc_id"], fingerprint(r["text"], k)

    return mapped(docs.select("doc_id", "text"), "doc_id long, fp long", rows)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(bit, shift, mask) of every one-wildcard variant."""
    parts = distance // 2 + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        for bit in range(lo, hi):
            out.append((bit, lo, ((1 << (hi - lo)) - 1) & ~(1 << (bit - lo))))
    return out


def _keys(fp: Column, distance: int) -> Column:
    each = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit(_signed(mask)).cast("long")).bitwiseXOR(F.lit(_signed((bit << 58) & (2**64 - 1))).cast("long")) for bit, lo, mask in variants(distance)]
    return F.array(*each)


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def linked(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable over links of at most `distance` differing bits, for every distinct fp of `fps`."""
    assert 0 <= distance <= 10, "a segment of few bits makes no index"
    spark = fps.sparkSession
    with scratch(spark):
        nodes = saved(fps.where("fp is not null").select("fp").distinct())
        keyed = nodes.repartition(partitions(spark), "fp").select("fp", F.explode(_keys(F.col("fp"), distance)).alias("key"))
        buckets = saved(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1"))
        pairs = buckets.where((F.col("n") == 2) & _near(F.col("low"), F.col("high"), distance)).select(F.col("low").alias("u"), F.col("high").alias("v"))
        large = saved(buckets.where("n > 2").select("key"))
        index = saved(keyed.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "key", "left_semi"))
        led = saved(_led(index))
        roots = saved(_joined(nodes.withColumn("root", F.col("fp")), pairs.unionByName(_to_leads(led, distance))))
        # a lead for all members but one: every pair has been compared
        rooted = saved(led.where(_OPEN).join(roots, "fp").select("key", "fp", "root"))
        return saved(_joined(roots, _across(rooted, distance)), outlives=True)


def _led(index: DataFrame) -> DataFrame:
    """key, fp, n (the bucket's members), leads (some distinct ones of them)."""
    drawn = [F.min("fp"), F.max("fp"), *[F.min(F.struct(F.xxhash64("fp", F.lit(i)), "fp"))["fp"] for i in range(DRAWN)]]
    leads = saved(index.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*drawn)).alias("leads")))
    return index.join(leads, "key").select("key", "fp", "n", "leads")


#: Whether a bucket has pairs of which neither is a lead.
_OPEN = "n > size(leads) + 1"


def _to_leads(led: DataFrame, distance: int) -> DataFrame:
    """(u, v): each fingerprint with the near leads of its bucket; with the smallest of them where the bucket has other pairs left."""
    near = F.filter("leads", lambda x: (x != F.col("fp")) & _near(x, F.col("fp"), distance))
    each = F.when(F.expr(_OPEN), F.slice(F.sort_array(near), 1, 1)).otherwise(near)
    return led.select(F.col("fp").alias("u"), F.explode(each).alias("v")).distinct()


def _across(rooted: DataFrame, distance: int) -> DataFrame:
    """(u, v): the roots of components of which a bucket (key, fp, root) holds two near members."""
    inside = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    # the largest component of each bucket that has several
    mixed = saved(inside.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "root"))["root"].alias("top")).where("kinds > 1").select("key", "top"))
    minor = saved(rooted.join(mixed, "key").where("root <> top").select("key", "fp", "root"))
    a, b = minor.alias("a"), rooted.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _near(F.col("a.fp"), F.col("b.fp"), distance)).select(F.col("a.root").alias("u"), F.col("b.root").alias("v"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """fp, root after the roots that `links` (u, v) name have been put together."""
    tops = components(links).select(F.col("u").alias("root"), F.col("root").alias("top"))
    return roots.join(tops, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Null and blank texts have fingerprint zero and link like any other.
    Repeated rows stay. A null doc_id stays a row and is never a component_id
    unless its component has no other. Columns other than doc_id and text are
    not read. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        prints = saved(fingerprints(docs, k), outlives=True)
        first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
        roots = linked(first, distance).join(first, "fp")
        tops = roots.groupBy("root").agg(F.min("first").alias("component_id"))
        named = saved(roots.join(tops, "root").select("fp", "component_id"), outlives=True)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, all columns unchanged: that with the smallest doc_id, then the smallest digest of its text.

    Rows without an id come after all others, and are deduplicated like them.
    Rows that agree in id and text are one document; of their other columns
    the smallest values by row are kept (map columns: any row's).
    """
    who = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]
    with scratch(docs.sparkSession):
        kept = saved(_kept(docs, who, distance), outlives=True)
    row = F.struct(*[docs[c] for c in docs.columns])
    ordered = all(not isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema)
    own = docs.select(*who, row.alias("row")).join(kept, ["none", "id", "h"], "left_semi")
    one = own.groupBy("none", "id", "h").agg((F.min("row") if ordered else F.first("row")).alias("row"))
    return one.select("row.*")


def _kept(docs: DataFrame, who: list[Column], distance: int) -> DataFrame:
    """none, id, h of the first document of each component."""
    prints = saved(mapped(docs.select("doc_id", "text", *who), "none boolean, id long, h long, fp long", lambda each: ((r["none"], r["id"], r["h"], fingerprint(r["text"])) for r in each)))
    roots = linked(prints, distance)
    return prints.join(roots, "fp").groupBy("root").agg(F.min(F.struct("none", "id", "h")).alias("w")).select("w.*")


RESULT = T.StructType().add("doc_id", "long").add("fingerprint", "string").add("component_id", "long")
