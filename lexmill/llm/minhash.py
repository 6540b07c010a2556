"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A signature has VALUES numbers of BITS bits, each from the smallest of a set's
shingle hashes under a function of its own; two sets of Jaccard similarity s
differ in a share of about 1 - s of them. It is split into chunks of CHUNK
values. Two signatures that differ in few values differ, in some chunk, in
ERRORS values at most (pigeonhole), so each chunk is indexed once for every
choice of ERRORS values that may be wrong, with those left out. Equal keys are
the candidates: all pairs within DISTANCE values, and nearly all of the others
that matter. At the line of 80 % a pair is missed if each of the 8 chunks has
two wrong values of four: about once in a million.

Equal sets are one class, whatever their number. A bucket of equal keys may
hold very many classes, so its pairs are not written out: all are held against
a few drawn from it, by sizes and 128 check bits and then on the full sets, the
likeliest pair of each class first. That makes components; only classes of
different components are compared after that, in tiles of bounded size, by
products of incidence matrices, of which links alone come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate, combinations, groupby

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, partitions, saved, scratch, table
from .graph import components
from .repeats import _mix, doc_key

#: Words in a shingle; least similarity in hundredths.
SHINGLE, LEAST = 2, 80
#: Values of a signature and bits of each; values in a chunk, and of those how many may be wrong.
VALUES, BITS, CHUNK, ERRORS = 32, 16, 4, 1
#: Within so many differing values a pair is sure to be a candidate.
DISTANCE = VALUES // CHUNK * (ERRORS + 1) - 1
#: Functions for the two-bit check values, and how many of their 128 bits may differ: at the line 12.8 do, and more than 40 once in 10 ** 10.
CHECKED, MOST_BITS = 64, 40
#: Documents that may be fetched by a broadcast of their keys.
MOST_BROADCAST = 200_000
_STEP = 1 << 11
#: Turned bits by which the classes are drawn that all others of a bucket are held against.
_DRAWN = (0, 0x5A5_1B2C_93D7, 0xA3C_E4D1_6E28, 0x3C6_B79A_D514, 0xFFF_FFFF_FFFF)
#: Classes and shingles in a tile, about; columns of a matrix.
TILE, TILE_SHINGLES, _COLUMNS = 1024, 400_000, 4096
_RANDOM = np.random.default_rng(20_117)
_FLIP, _TIMES = (_RANDOM.integers(0, 1 << 63, CHECKED, dtype=np.uint64)[:, None] for _ in range(2))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)


def shingles(lowered: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; with fewer words, of all words as one; none without words."""
    words = lowered.split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts, hashed = [0, *ends[:-1]], xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(flat[s : e - 1]) for s, e in zip(starts, ends[min(k, len(words)) - 1 :], strict=False)), np.uint64))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The VALUES // CHUNK chunks of a non-empty set's signature, and its two longs of check bits."""
    least = np.full(CHECKED, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), _STEP):
        np.minimum(least, ((hashes[i : i + _STEP] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    least = _mix(least)
    low = least & np.uint64(3)
    check = (low.reshape(2, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)
    return (least[:VALUES] >> np.uint64(64 - BITS)).astype("<u2").view("<i8"), check.view(np.int64)


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, d, h, n (distinct shingles), s0, s1 (digest of the set), sig, c0, c1 of every whole text; without words all from s0 on are null."""

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        for r in each:
            own = shingles(_lowered(r["text"]), k)
            if not len(own):
                yield r["doc_id"], r["d"], r["h"], 0, None, None, None, None, None
                continue
            chunks, check = signature(own)
            s0, s1 = np.frombuffer(blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
            yield r["doc_id"], r["d"], r["h"], len(own), s0, s1, chunks.tolist(), int(check[0]), int(check[1])

    return mapped(docs.select("doc_id", *doc_key(), "text"), "doc_id long, d long, h long, n long, s0 long, s1 long, sig array<long>, c0 long, c1 long", rows)


def keys(sig: Column) -> Column:
    """array of keys: each chunk without each choice of ERRORS values."""
    out = []
    for c in range(VALUES // CHUNK):
        for i, wrong in enumerate(combinations(range(CHUNK), ERRORS)):
            mask = sum(((1 << BITS) - 1) << (BITS * j) for j in range(CHUNK) if j not in wrong)
            out.append(F.xxhash64(F.lit(c * 100 + i), F.get(sig, c).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*out)


def _differ(a: str, b: str) -> Column:
    """Check bits that differ."""
    return F.bit_count(F.col(f"{a}.c0").bitwiseXOR(F.col(f"{b}.c0"))) + F.bit_count(F.col(f"{a}.c1").bitwiseXOR(F.col(f"{b}.c1")))


def _may(a: str, b: str, least: int) -> Column:
    """Whether sizes and check bits allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= least * F.greatest(n, m)) & (_differ(a, b) <= MOST_BITS)


def _close(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """u, v, far, and the document (ud, uh, vd, vh) of each: the pairs that sizes and check bits allow."""
    a, b = (classes.select(F.col("node").alias(x), "n", "c0", "c1", "d", "h").alias(x) for x in "uv")
    met = pairs.alias("p").join(a, F.col("p.u") == F.col("u.u")).join(b, F.col("p.v") == F.col("v.v")).where(_may("u", "v", least))
    return met.select("p.u", "p.v", _differ("u", "v").alias("far"), F.col("u.d").alias("ud"), F.col("u.h").alias("uh"), F.col("v.d").alias("vd"), F.col("v.h").alias("vh"))


def _packed(docs: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """The columns of wanted other than d and h, and the text of document (d, h), lower-cased and compressed, as `text`."""
    carried = [c for c in wanted.columns if c not in ("d", "h")]
    met = docs.select(*doc_key(), "text").join(F.broadcast(wanted) if few else wanted, ["d", "h"]).select(*carried, "text")

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        pack = zstandard.ZstdCompressor().compress
        for r in each:
            yield *[r[c] for c in carried], pack(_lowered(r["text"]))

    return mapped(met, ", ".join(f"{c} long" for c in carried) + ", text binary", rows, 64)


def confirmed(docs: DataFrame, pairs: DataFrame, least: int = LEAST, k: int = SHINGLE) -> DataFrame:
    """u, v of the pairs (u, v, ud, uh, vd, vh) whose full sets are similar.

    The text of v travels to that of u; a repeated row of either gives a link again.
    """
    few = pairs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    one = _packed(docs, pairs.select(F.col("ud").alias("d"), F.col("uh").alias("h"), "u").distinct(), few).withColumnRenamed("text", "a")
    other = _packed(docs, pairs.select(F.col("vd").alias("d"), F.col("vh").alias("h"), "u", "v"), few).withColumnRenamed("text", "b")

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, own = None, np.zeros(0, np.uint64)
        for r in each:
            if r["u"] != last:
                last, own = r["u"], shingles(unpack(r["a"]), k)
            theirs = shingles(unpack(r["b"]), k)
            both = len(np.intersect1d(own, theirs, assume_unique=True))
            if 100 * both >= least * (len(own) + len(theirs) - both):
                yield r["u"], r["v"]

    return mapped(one.join(other, "u").select("u", "v", "a", "b"), "u long, v long", rows)


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with their roots ru and rv."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
    return pairs.join(a, "u").join(b, "v").where("ru <> rv")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after the components that links (u, v) join have been put together."""
    between = _rooted(links.select("u", "v"), roots).select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    tops = components(between).select(F.col("u").alias("root"), F.col("root").alias("top"))
    return saved(roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _to_leads(index: DataFrame, drawn: tuple[int, ...]) -> DataFrame:
    """(u, v), u < v: each class of a bucket (key, node) with some others, the same for all of the bucket: those that are least after some bits are turned."""
    leads = saved(index.groupBy("key").agg(F.array_distinct(F.array(*[F.min(F.col("node").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in drawn])).alias("leads")))
    met = index.join(leads, "key").select("node", F.explode("leads").alias("lead")).where("node <> lead")
    return met.select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v")).distinct()


def linked(docs: DataFrame, classes: DataFrame, least: int = LEAST, k: int = SHINGLE) -> DataFrame:
    """node, root for every class (node, n, sig, c0, c1 and a document d, h of it).

    The likeliest pair of each class is confirmed first; then, between
    components only, its others with the classes drawn, and all that are left.
    """
    spark = docs.sparkSession
    keyed = classes.repartition(partitions(spark), "node").select("node", F.explode(keys(F.col("sig"))).alias("key"))
    buckets = saved(keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("u"), F.max("node").alias("v")).where("members > 1"))
    index = saved(keyed.join(saved(buckets.where("members > 2").select("key")), "key"))
    tried = saved(_close(buckets.where("members = 2").select("u", "v").unionByName(_to_leads(index, _DRAWN)).distinct(), classes, least))
    best = saved(tried.groupBy("v").agg(F.min(F.struct("far", "u", "ud", "uh", "vd", "vh")).alias("x")).select("x.*", "v"))
    roots = _merged(classes.select("node", F.col("node").alias("root")), saved(confirmed(docs, best, least, k)))
    left = saved(_rooted(tried.join(best.select("u", "v"), ["u", "v"], "left_anti"), roots).drop("ru", "rv"))
    if left.take(1):
        roots = _merged(roots, saved(confirmed(docs, left, least, k)))
    mixed = _mixed(index, roots)
    return _merged(roots, saved(_across(docs, mixed, classes, least, k))) if mixed.take(1) else roots


def _mixed(index: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root, top: the classes of buckets that hold several components, and the component that most of a bucket is in."""
    rooted = index.join(roots, "node").select("key", "node", "root")
    inside = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = saved(inside.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "root"))["root"].alias("top")).where("kinds > 1").select("key", "top"))
    return saved(rooted.join(several, "key"))


def _in_common(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one has in common with each of other, by products of parts of their incidence matrices."""
    out = np.zeros((len(one), len(other)), np.float32)
    flat = [np.concatenate(x) for x in (one, other)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if not len(both):
        return out
    placed = []
    for sets, x in zip((one, other), flat, strict=True):
        at = np.searchsorted(both, x)
        at[at == len(both)] = 0
        held = both[at] == x
        placed.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], at[held], len(sets)))
    for i in range(0, len(both), _COLUMNS):
        parts = []
        for row, col, n in placed:
            own = (col >= i) & (col < i + _COLUMNS)
            part = np.zeros((n, min(_COLUMNS, len(both) - i)), np.float32)
            part[row[own], col[own] - i] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _similar(one: list[dict], other: list[dict], least: int, k: int) -> Iterator[tuple[int, int]]:
    """Links between members of different components: for each member of one, one to every component of other that it is similar to."""
    unpack = zstandard.ZstdDecompressor().decompress
    sets = [[shingles(unpack(r["text"]), k) for r in x] for x in ((one, other) if one is not other else (one,))]
    common = _in_common(sets[0], sets[-1])
    n, m = (np.array([len(s) for s in x]) for x in (sets[0], sets[-1]))
    roots = np.array([r["root"] for r in other])
    near = (100 * common >= least * (n[:, None] + m[None, :] - common)) & (np.array([r["root"] for r in one])[:, None] != roots[None, :])
    for i in np.nonzero(near.any(axis=1))[0].tolist():
        at = np.nonzero(near[i])[0]
        for j in at[np.unique(roots[at], return_index=True)[1]].tolist():
            yield one[i]["node"], other[j]["node"]


def _across(docs: DataFrame, mixed: DataFrame, classes: DataFrame, least: int, k: int) -> DataFrame:
    """u, v: links between components of a bucket, by full sets; of its largest component none with each other.

    A bucket's classes are dealt to tiles of bounded size, and tiles are laid
    beside each other; links come out, never pairs that are none.
    """
    told = mixed.join(classes.select("node", "n", "d", "h"), "node").withColumn("minor", F.col("root") != F.col("top"))
    spread = lambda own: F.ceil(F.greatest(F.count_if(own) / TILE, F.sum(F.when(own, F.col("n")).otherwise(F.lit(0))) / TILE_SHINGLES)).cast("int")
    tiles = saved(told.groupBy("key").agg(spread(F.col("minor")).alias("minors"), spread(~F.col("minor")).alias("tops")))
    placed = told.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("tops"))).cast("int"))
    beside = lambda n, met: F.transform(F.sequence(F.lit(0), F.col(n) - 1), met)
    pair = lambda x, y, all_minor: F.struct(x.cast("int").alias("a"), y.cast("int").alias("b"), F.lit(all_minor).alias("c"))
    own = F.col("tile")
    groups = F.when(F.col("minor"), F.concat(beside("tops", lambda j: pair(own, j, 0)), beside("minors", lambda i: pair(F.least(own, i), F.greatest(own, i), 1)))).otherwise(beside("minors", lambda i: pair(i, own, 0)))
    rows = placed.select("key", "node", "root", "minor", "tile", F.explode(groups).alias("g")).select("key", "g.*", "node", "root", "minor", "tile")
    wanted = saved(told.select("d", "h", "node").distinct())
    texts = saved(_packed(docs, wanted, wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST))
    group = ["key", "a", "b", "c"]
    dealt = rows.join(texts, "node").repartition(partitions(docs.sparkSession), *group).sortWithinPartitions(*group, "node")

    def found(each: Iterator[dict]) -> Iterator[tuple]:
        for (_, a, b, all_minor), members in groupby(each, key=lambda r: tuple(r[x] for x in group)):
            held = [next(same) for _, same in groupby(members, key=lambda r: r["node"])]  # a repeated row gives its text again
            if all_minor:
                one = [r for r in held if r["tile"] == a]
                other = one if a == b else [r for r in held if r["tile"] == b]
            else:
                one, other = [r for r in held if r["minor"]], [r for r in held if not r["minor"]]
            if one and other:
                yield from _similar(one, other, least, k)

    return mapped(dealt, "u long, v long", found)


def near_duplicates(docs: DataFrame, least: int = LEAST, k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept.

    Null and blank texts have no shingles and link with nothing, not even each
    other. Repeated rows stay, each with its component. A row without a doc_id
    stays; its component_id is null unless its component has an id, and it is
    kept only where it has none. Columns other than doc_id and text are not
    read. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        prints = saved(signatures(docs, k), outlives=True)
        own = prints.where("n > 0")
        grouped = own.groupBy("s0", "s1").agg(F.min("doc_id").alias("first"), F.min(F.struct("d", "h")).alias("at"), *[F.first(c).alias(c) for c in ("n", "sig", "c0", "c1")])
        # numbers of classes are fixed once they are written
        classes = saved(grouped.select("s0", "s1", "first", "at.*", "n", "sig", "c0", "c1", F.monotonically_increasing_id().alias("node")))
        roots = linked(docs, classes, least, k)
        placed = classes.join(roots, "node").select("s0", "s1", "first", "root")
        tops = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        named = saved(placed.join(tops, "root").select("s0", "s1", "component_id"), outlives=True)
    each = own.join(named, ["s0", "s1"]).select("doc_id", "n", "component_id").unionByName(prints.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return each.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle are compared.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM i JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
r AS (SELECT doc_id AS u, doc_id AS root FROM s UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.root)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept
FROM s JOIN r ON r.u = s.doc_id GROUP BY s.doc_id, s.s
"""
