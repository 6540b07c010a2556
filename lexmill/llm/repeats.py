"""Where texts repeat: routing that brings every two equal windows of tokens together.

A window is `width` consecutive tokens. The smallest of its k-gram hashes (its
anchor) depends on nothing but the window's tokens, so equal windows have equal
anchors at equal places. Consecutive windows with one anchor make a run, whose
tokens are a segment. Only anchors that are found twice or more matter; their
distinct segments are dealt to shards by anchor, and a method of the caller's
(automata, suffix arrays) decides inside a shard which windows repeat. Equal
segments enter a shard once, with their number, so a passage that a third of
all documents share is one entry. What the method finds for a segment then
holds for every place where it stands. Segments are equal if their bytes have
one 128-bit BLAKE2 digest, for which no two different texts are known or can be
made; the faster hashes of tokens and k-grams only say which task does what.

A single text may have up to 2 ** 30 tokens.

A common phrase among different words would be the anchor of very many
distinct segments. So the commonest k-grams are counted first and come last in
the order: they are the anchor of windows that hold nothing else. If an anchor
still has more segments than a shard takes, they are split, exactly: a window
that has the anchor at one of `size` neighbouring places holds the tokens that
all such windows have in common (their core), so equal windows have equal cores
and the anchor, band and core together are a finer anchor. Bands get narrower
until a group is small; at a band of one place the core is the window itself.
The same method decides about the pieces.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved, scratch

#: Bytes of text that are hashed at once; bits for a place among their tokens; common k-grams that come last, at most.
FLUSH, PLACE, COMMON = 1 << 21, 30, 10_000
_NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(2024).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: int):
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.held = (np.ones(1, np.uint64),) * 2

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            size = max(n, 1 << 16)
            self.held = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64)))) for x in self.bases)
        return self.held


_FIRST = _Powers(_BASE)


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values times powers, from 0; differences times a power of the inverse are hashes of ranges."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _FIRST.of(len(values) + 1)[0][: len(values)])))


def window_digests(values: np.ndarray, width: int) -> np.ndarray:
    """A digest of every `width` consecutive values."""
    n = len(values) - width + 1
    sums = _sums(values)
    return _mix((sums[width:] - sums[:n]) * _FIRST.of(len(values) + 1)[1][:n])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Tokens:
    """Token hashes of several texts in a row; text i has tokens bounds[i] to bounds[i + 1], token k is data[starts[k]:ends[k]]."""

    values: np.ndarray
    bounds: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray


def byte_tokens(texts: list[bytes]) -> Tokens:
    data = b"".join(texts)
    places = np.arange(len(data) + 1)
    return Tokens(_BYTE[np.frombuffer(data, np.uint8)], np.cumsum([0, *map(len, texts)]), data, places[:-1], places[1:])


def word_tokens(texts: list[bytes]) -> Tokens:
    """Runs of bytes other than ASCII white space; in data they are one space apart."""
    texts = [b" ".join(t.split()) for t in texts]
    data = b" " + b" ".join(texts) + b" "
    flat = np.frombuffer(data, np.uint8)
    blank = _SPACE[flat]
    starts = np.nonzero(blank[:-1] & ~blank[1:])[0] + 1
    ends = np.nonzero(~blank[:-1] & blank[1:])[0] + 1
    sums, down = _sums(_BYTE[flat]), _FIRST.of(len(flat) + 1)[1]
    places = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return Tokens(_mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, places), data, starts, ends)


@dataclass(frozen=True)
class Windows:
    """How texts are cut: width tokens a window, k tokens a k-gram; `common` k-gram hashes come last."""

    width: int
    k: int
    tokens: Callable[[list[bytes]], Tokens]
    common: tuple[int, ...] = ()

    def order(self, grams: np.ndarray) -> np.ndarray:
        """k-gram hashes as they are compared: the common ones above all others."""
        out = grams >> np.uint64(1)
        if self.common:
            known = np.array(self.common, np.int64).view(np.uint64)
            low = np.uint64((1 << 20) - 1)
            seen = np.zeros(1 << 20, bool)
            seen[(known & low).astype(np.int64)] = True
            at = np.nonzero(seen[(grams & low).astype(np.int64)])[0]
            out[at[np.isin(grams[at], known)]] |= np.uint64(1 << 63)
        return out

    def frequent(self, texts: list[bytes], least: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(hash, places) of the k-grams found `least` times or more in these texts, among those small enough to become anchors.

        A k-gram above the lowest 12 / (k-grams in a window) of all hashes is a window's smallest once in 160,000 times.
        """
        t = self.tokens(texts).values
        if len(t) < self.k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = self.grams(t)
        part = min(1.0, 12 / (self.width - self.k + 1))
        found, n = np.unique(grams[grams <= np.uint64(int(part * ((1 << 64) - 1025)))], return_counts=True)
        return found[n >= least].view(np.int64), n[n >= least]

    def grams(self, values: np.ndarray) -> np.ndarray:
        """k-gram hashes."""
        sums, down = _sums(values), _FIRST.of(len(values) + 1)[1]
        return _mix((sums[self.k :] - sums[: -self.k]) * down[: len(values) - self.k + 1])

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, at, n, rel, anchor, segment, check) of every run of windows with one anchor, which begins `rel` tokens after `at`."""
        t = self.tokens(texts)
        size = len(t.values)
        none = np.zeros(0, np.int64)
        if size < self.width:
            return (none,) * 7
        if size >= 1 << PLACE:
            raise ValueError("a text has too many tokens")
        grams = self.grams(t.values)
        place = np.uint64((1 << PLACE) - 1)
        least = (self.order(grams) & ~place) | np.arange(len(grams), dtype=np.uint64)
        reach, wide = 1, self.width - self.k + 1
        while 2 * reach <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if wide > reach:
            least = np.minimum(least[: reach - wide], least[wide - reach :])
        anchor = (least & place).astype(np.int64)
        change = np.zeros(len(anchor) + 1, np.int64)
        has = t.bounds[1:] - t.bounds[:-1] >= self.width
        change[t.bounds[:-1][has]] += 1
        change[t.bounds[1:][has] - self.width + 1] -= 1
        inside = np.cumsum(change[:-1]) > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
        at = np.nonzero(first)[0]
        n = np.nonzero(last)[0] - at + 1
        end = at + n + self.width - 1
        data = memoryview(t.data)
        named = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(t.starts[at].tolist(), t.ends[end - 1].tolist(), strict=True)])
        segment, check = np.frombuffer(named, np.int64).reshape(-1, 2).T
        text = np.searchsorted(t.bounds, at, side="right") - 1
        return text, at - t.bounds[text], n, anchor[at] - at, grams[anchor[at]].view(np.int64), segment, check


def doc_key() -> tuple[Column, Column]:
    """Names a row by its id and text; rows that agree in both have the same result."""
    return F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("h")


#: What names a distinct segment.
KEY = ["anchor", "segment", "check"]
_RUN = pa.struct([("anchor", pa.int64()), ("segment", pa.int64()), ("check", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("rel", pa.int32())])


def marks(docs: DataFrame, windows: Windows) -> DataFrame:
    """d, h, runs (anchor, segment, check, at, n, rel) of every whole text that has a window."""
    schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("runs", pa.list_(_RUN))])

    def out(d: list, h: list, texts: list[bytes]) -> pa.RecordBatch:
        text, at, n, rel, anchor, segment, check = windows.runs(texts)
        offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip((anchor, segment, check, at, n, rel), [f.type for f in _RUN], strict=True)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, h, texts, size = [], [], [], 0
        for b in batches:
            cols = b.to_pydict()
            for x, y, text in zip(cols["d"], cols["h"], cols["text"], strict=True):
                data = text.encode()
                d.append(x)
                h.append(y)
                texts.append(data)
                size += len(data)
                if size >= FLUSH:
                    yield out(d, h, texts)
                    d, h, texts, size = [], [], [], 0
        if texts:
            yield out(d, h, texts)

    made = docs.where("text is not null").select(*doc_key(), "text").mapInArrow(run, "d long, h long, runs array<struct<anchor:long,segment:long,check:long,at:int,n:int,rel:int>>")
    return made.where(F.size("runs") > 0)


#: Bytes of segments that a task gathers before it passes them on.
_OUT = 1 << 22
_SEGMENT = "anchor long, segment long, check long, number long, n int, rel int, kinds long, tokens binary"
_SEGMENT_ARROW = pa.schema([(x, pa.int64()) for x in (*KEY, "number")] + [("n", pa.int32()), ("rel", pa.int32()), ("kinds", pa.int64()), ("tokens", pa.binary())])
Cut = Callable[[bytes], Callable[[int, int], bytes]]


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last column is bytes, of about _OUT of those."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= _OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _sliced(parts: DataFrame, docs: DataFrame, cut: Cut, width: int) -> DataFrame:
    """Segments with their tokens, cut out of the document that each is read from; a repeated row of it may give them again."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for b in batches:
            for row in b.to_pylist():
                if (row["d"], row["h"]) == last:
                    continue
                last = row["d"], row["h"]
                piece = cut(row["text"].encode())
                for p in row["parts"]:
                    yield p["anchor"], p["segment"], p["check"], p["number"], p["n"], p["rel"], p["kinds"], piece(p["at"], p["at"] + p["n"] + width - 1)

    by_doc = parts.groupBy("d", "h").agg(F.collect_list(F.struct(*KEY, "number", "at", "n", "rel", "kinds")).alias("parts"))
    texts = docs.where("text is not null").select(*doc_key(), "text").join(by_doc, ["d", "h"]).select("d", "h", "text", "parts")
    return texts.mapInArrow(lambda batches: _batched(pieces(batches), _SEGMENT_ARROW), _SEGMENT)


def cut_bytes(text: bytes) -> Callable[[int, int], bytes]:
    return lambda a, b: text[a:b]


def cut_words(text: bytes) -> Callable[[int, int], bytes]:
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


#: (segments, tokens) of a shard to the repeated windows of each: segments are (number of places, windows, bytes).
Method = Callable[[list[tuple[int, int, bytes]]], Iterator[np.ndarray]]


def _spans(repeated: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """Start and end of the token ranges that repeated windows cover."""
    at = np.nonzero(repeated)[0]
    if not len(at):
        return [], []
    gap = np.nonzero(at[1:] - at[:-1] > width)[0]
    return at[np.concatenate(([0], gap + 1))].tolist(), (at[np.concatenate((gap, [len(at) - 1]))] + width).tolist()


_COVER = "anchor long, segment long, check long, lo array<int>, hi array<int>"
_COVER_ARROW = pa.schema([(x, pa.int64()) for x in KEY] + [("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])


def _in_shards(segments: DataFrame, method: Method, width: int, per_shard: int) -> DataFrame:
    """KEY, lo, hi: what the method finds, shard by shard; a task holds one shard at a time."""
    shards = max(partitions(segments.sparkSession), -(-segments.count() // per_shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]) -> pa.RecordBatch:
            found = [_spans(x, width) for x in method([(r["number"], r["n"], r["tokens"]) for r in rows])]
            cols = (*[[r[k] for r in rows] for k in KEY], [x[0] for x in found], [x[1] for x in found])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _COVER_ARROW.types, strict=True)], schema=_COVER_ARROW)

        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[-1]["shard"] != r["shard"]:
                    yield done(held)
                    held = []
                if not held or any(held[-1][k] != r[k] for k in KEY):  # a segment that was cut twice is one
                    held.append(r)
        if held:
            yield done(held)

    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", *KEY)
    return dealt.select("shard", *KEY, "number", "n", "tokens").mapInArrow(run, _COVER).where(F.size("lo") > 0)


def _number(data: bytes, size: int) -> tuple[int, ...]:
    """64-bit numbers from a digest of data."""
    return struct.unpack(f"<{size}q", blake2b(data, digest_size=8 * size).digest())


def _pieces(segments: DataFrame, cut: Cut, width: int, size: int) -> DataFrame:
    """Each segment cut to bands of `size` places of its anchor: of (its KEY), first (its window that the piece begins with), and the piece as a segment."""
    schema = pa.schema([pa.field("of", pa.struct([(k, pa.int64()) for k in KEY])), ("first", pa.int32()), *[f for f in _SEGMENT_ARROW if f.name != "kinds"]])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for r in b.to_pylist():
                piece, of, n, rel = cut(r["tokens"]), {k: r[k] for k in KEY}, r["n"], r["rel"]
                for band in range((rel - n + 1) // size, rel // size + 1):
                    first, last = max(0, rel - band * size - size + 1), min(n - 1, rel - band * size)
                    core, tokens = piece(rel - band * size, rel - band * size - size + 1 + width), piece(first, last + width)
                    anchor = _number(struct.pack("<3q", r["anchor"], band, size) + core, 1)
                    yield of, first, *anchor, *_number(struct.pack("<q", last - first) + tokens, 2), r["number"], last - first + 1, rel - first, tokens

    shape = "of struct<anchor:long,segment:long,check:long>, first int, " + _SEGMENT.replace("kinds long, ", "")
    return segments.mapInArrow(lambda batches: _batched(cuts(batches), schema), shape)


def _repeated(segments: DataFrame, method: Method, windows: Windows, cut: Cut, per_shard: int, most: int, sizes: tuple[int, ...]) -> DataFrame:
    """KEY, lo, hi of the segments with repeated windows; anchors of more than `most` are split by bands of the given sizes in turn."""
    few = _in_shards(segments.where(F.col("kinds") <= most) if sizes else segments, method, windows.width, per_shard)
    many = segments.where(F.col("kinds") > most)
    if not sizes or not many.take(1):
        return few
    pieces = saved(_pieces(many.dropDuplicates(KEY), cut, windows.width, sizes[0]))
    distinct = saved(pieces.groupBy(*KEY).agg(F.sum("number").alias("number"), *[F.first(x).alias(x) for x in ("n", "rel", "tokens")]))
    kinds = saved(distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("number").alias("n_most")).where("kinds > 1 or n_most > 1").select("anchor", "kinds"))
    again = saved(distinct.join(kinds, "anchor").select(*[x.split()[0] for x in _SEGMENT.split(", ")]))
    found = saved(_repeated(again, method, windows, cut, per_shard, most, sizes[1:]))
    spans = pieces.select("of", "first", *KEY).join(found, KEY).select("of.*", F.transform(F.arrays_zip("lo", "hi"), lambda s: F.struct((s["lo"] + F.col("first")).alias("lo"), (s["hi"] + F.col("first")).alias("hi"))).alias("s"))
    # a segment has as many windows as an anchor has places, so its spans are few
    whole = spans.groupBy(*KEY).agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    return few.unionByName(whole.select(*KEY, F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")))


def common_grams(docs: DataFrame, windows: Windows, most: int) -> tuple[int, ...]:
    """The commonest k-grams among those found in more than `most` places; COMMON at most, so they may go to every task.

    They change which task does what, never what is found.
    """
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                texts.append(text.encode())
                size += len(texts[-1])
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in windows.frequent(texts)], schema=schema)
                    texts, size = [], 0
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in windows.frequent(texts)], schema=schema)

    counted = docs.where("text is not null").select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return tuple(sorted(r["gram"] for r in counted.where(F.col("n") > most).orderBy(F.desc("n"), "gram").limit(COMMON).collect()))


def covered(docs: DataFrame, windows: Windows, cut: Cut, method: Method, per_shard: int, most: int, sizes: tuple[int, ...]) -> DataFrame:
    """d, h, spans array<struct<lo,hi>>: for each document the token ranges of windows that also start elsewhere; spans may overlap.

    A shard gets about per_shard segments; an anchor with more than `most`
    distinct ones is split by bands of `sizes` places, which fall to 1.
    """
    with scratch(docs.sparkSession):
        windows = replace(windows, common=common_grams(docs, windows, most))
        runs = saved(marks(docs, windows))
        flat = runs.select("d", "h", F.explode("runs").alias("r")).select("d", "h", "r.*")
        # written tables as the small sides of joins, so that adaptive execution can split a hot anchor
        often = saved(flat.groupBy("anchor").agg(F.count("*").alias("places")).where("places > 1").select("anchor"))
        live = saved(flat.join(often, "anchor"))
        # any place will do; by a digest, so that no document gives more than its share of segments
        drawn = F.struct(F.xxhash64("d", "h", "segment").alias("draw"), "d", "h", "at", "n", "rel")
        first = live.groupBy(*KEY).agg(F.count("*").alias("number"), F.min(drawn).alias("at"))
        distinct = saved(first.select(*KEY, "number", "at.*").drop("draw"))
        kinds = saved(distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("number").alias("n_most")).where("kinds > 1 or n_most > 1").select("anchor", "kinds"))
        segments = saved(_sliced(distinct.join(kinds, "anchor"), docs, cut, windows.width))
        found = saved(_repeated(segments, method, windows, cut, per_shard, most, sizes))
        own = live.join(found, KEY).select("d", "h", F.explode(F.arrays_zip("lo", "hi")).alias("s"), "at")
        spans = own.groupBy("d", "h").agg(F.collect_set(F.struct((F.col("s.lo") + F.col("at")).alias("lo"), (F.col("s.hi") + F.col("at")).alias("hi"))).alias("spans"))
        return saved(spans, outlives=True)


def removed(docs: DataFrame, spans: DataFrame, run: Callable[[bytes, list[tuple[int, int]]], tuple], schema: str, arrow: pa.Schema) -> DataFrame:
    """run(text, merged spans) for each row of docs, with doc_id first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            out = [(i, *run((t or "").encode(), merged(s or []))) for i, t, s in zip(x["doc_id"], x["text"], x["spans"], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    d, h = doc_key()
    return docs.select("doc_id", "text", d, h).join(spans, ["d", "h"], "left").select("doc_id", "text", "spans").mapInArrow(rows, schema)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Disjoint sorted ranges; ranges that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["lo"], s["hi"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
