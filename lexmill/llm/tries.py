"""The prefix trie of rebuilt conversations, from a Cartesian tree over their sorted LCP array.

Conversations are sorted by the digests of their turns, and each is laid beside
the one before it: the number of turns that both begin with is its LCP value.
A node of the trie at which conversations part or end is an LCP interval: the
stretch between the nearest smaller values on both sides of a value. Equal
values with one stretch are one node, so the Cartesian tree of the array, equal
values merged, is the trie without its unbranched stretches. Those depths are
expanded, and what a node needs is read off its stretch.

No conversation, block or node is one task's alone. Turns are numbered by
range partitions and the counts of those before them. Sorted conversations
stay in the blocks in which they were sorted; nearest smaller values are found
inside a block, and beyond it by the blocks' minima (one number a block) and
the records of the block that has them. Subtrees are stretches of the nodes in
preorder, so their sums are differences of running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, saved, scratch, table

#: Conversations of one group lend their first turns; of how many is a remainder of a checksum.
GROUP, LENT = 5, 9
#: Hex digits that name a turn; turns that a sort key has at first, and how much longer it gets where keys tie.
_NAME, FIRST, LONGER = 32, 32, 4
#: Ids that are joined to one string at most.
_IDS = 4096


def lent(conv: Column) -> Column:
    """How many turns of its group's first conversation a conversation begins with."""
    return (F.crc32(conv.cast("string")) % LENT).cast("long")


@dataclass(frozen=True)
class _Sum:
    """A column's running sum, in the order of a table, under a name; within equal values of `per` if one is given."""

    column: str
    name: str


def _numbered(df: DataFrame, order: list[Column], bounds: list[Column], per: str | None, sums: list[_Sum]) -> DataFrame:
    """df in range partitions by `bounds` (a prefix of `order`), with `at` (the rows before this one) and sums over those rows, all within equal values of `per`.

    A partition counts its own rows. Where a value of `per` goes on from the
    partition before, what that has of it is added: a row a partition.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    names = ["at", *[s.name for s in sums]]
    shape = df.limit(0).withColumns({"pid": F.lit(0), **{x: F.lit(0).cast("long") for x in names}}).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, held = TaskContext.get().partitionId(), None, [0] * len(names)
        for b in batches:
            if not b.num_rows:
                continue
            size = b.num_rows
            key = b.column(per).to_numpy(zero_copy_only=False) if per else np.zeros(size, np.int64)
            new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(size), -1))  # -1: goes on from the last batch
            out = []
            for k, values in enumerate([np.ones(size, np.int64), *[b.column(s.column).to_numpy(zero_copy_only=False).astype(np.int64) for s in sums]]):
                before = np.concatenate(([0], np.cumsum(values)))
                since = np.where(start < 0, -held[k], before[np.maximum(start, 0)])
                out.append(before[:-1] - since)
                held[k] = int(before[-1] - since[-1])
            last = key[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(size, pid), pa.int32()), *[pa.array(x, pa.int64()) for x in out]], schema=arrow)

    ordered = df.repartitionByRange(n, *bounds).sortWithinPartitions(*order)
    done = saved(ordered.mapInArrow(run, shape))
    key = F.col(per) if per else F.lit(0)
    ends = {r["pid"]: (r["first"], r["last"]) for r in done.groupBy("pid").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()}
    # values that go on across a border, and what each partition has of them: no more rows than borders have sides
    pids = sorted(ends)
    across = sorted({ends[a][1] for a, b in zip(pids, pids[1:], strict=False) if ends[a][1] == ends[b][0]})
    own = done.where(key.isin(across)).groupBy("pid", key.alias("of")).agg(F.count("*").alias("n"), *[F.sum(s.column).alias(s.name) for s in sums]).collect() if across else []
    carry, held = [], {}
    for r in sorted(own, key=lambda r: (r["of"], r["pid"])):
        before = held.get(r["of"], (0,) * len(names))
        carry.append((r["pid"], r["of"], *before))
        held[r["of"]] = tuple(x + (y or 0) for x, y in zip(before, (r["n"], *[r[s.name] for s in sums]), strict=True))
    if not carry:
        return done.drop("pid")
    more = spark.createDataFrame(carry, "pid int, _of long, " + ", ".join(f"_{x} long" for x in names))
    joined = done.join(F.broadcast(more), (done["pid"] == more["pid"]) & (key == more["_of"]), "left")
    return joined.select(*df.columns, *[(F.col(x) + F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in names])


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, at, name, bytes, below: each turn's place in its conversation, its digest, the bytes of its text and of those before it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    named = rows.withColumn("head", F.left("text", F.lit(64))).withColumn("name", F.left(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), F.lit(_NAME)))
    return _numbered(named, order, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head")], "conv", [_Sum("bytes", "below")])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, len) of every conversation after rebuilding, and its turns (conv, pos, name, bytes, below)."""
    turns = _turns(conversations).select("conv", "at", "name", "bytes", "below")
    turn = F.struct("at", "name", "bytes", "below")
    heads = saved(turns.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("at") < LENT, turn))).alias("head")))
    base = heads.select(F.col("conv").alias("of"), F.col("n").alias("n0"), F.col("head").alias("head0"))
    own = heads.withColumn("of", F.col("conv") - F.col("conv") % GROUP).withColumn("h", lent(F.col("conv"))).join(base, "of", "left")
    first = F.slice("head0", F.lit(1), F.least(F.col("h"), F.coalesce("n0", F.lit(0))).cast("int"))
    plan = own.select("conv", "n", "h", "head", F.coalesce(first, F.array().cast(heads.schema["head"].dataType)).alias("lead")).withColumn("m", F.size("lead").cast("long"))
    past = lambda x: x["below"] + x["bytes"]
    led, cut = F.when(F.col("m") > 0, past(F.get("lead", (F.col("m") - 1).cast("int")))).otherwise(F.lit(0)), F.when(F.col("h") > 0, past(F.get("head", (F.col("h") - 1).cast("int")))).otherwise(F.lit(0))
    plan = saved(plan.select("conv", "h", "lead", (F.col("m") - F.col("h")).alias("move"), (led - cut).alias("grow"), (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    lead = plan.select("conv", F.explode("lead").alias("t")).select("conv", F.col("t.at").alias("pos"), "t.name", "t.bytes", "t.below")
    rest = turns.where(F.col("at") >= lent(F.col("conv"))).join(plan.select("conv", "move", "grow"), "conv").select("conv", (F.col("at") + F.col("move")).alias("pos"), "name", "bytes", (F.col("below") + F.col("grow")).alias("below"))
    return plan.select("conv", "len"), saved(lead.unionByName(rest))


def _keyed(convs: DataFrame, turns: DataFrame, limit: int) -> DataFrame:
    """conv, len, key: the names of the first `limit` turns in a row."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "")
    keys = turns.where(F.col("pos") < limit).groupBy("conv").agg(names.alias("key"))
    return convs.join(keys, "conv", "left").select("conv", "len", F.coalesce("key", F.lit("")).alias("key"))


def sort_keys(convs: DataFrame, turns: DataFrame, first: int = FIRST) -> DataFrame:
    """conv, len, key: as many turns of each as tell it from all others that are not the same or end there; never a hot conversation whole."""
    limit, keys = first, saved(_keyed(convs, turns, first))
    while True:
        tied = saved(keys.where(F.col("len") >= limit).where(F.length("key") == limit * _NAME).groupBy("key").agg(F.count("*").alias("n"), F.max("len").alias("most")).where((F.col("n") > 1) & (F.col("most") > limit)).select("key"))
        if not tied.take(1):
            return keys
        longer = saved(keys.where(F.col("len") > limit).join(tied, "key", "left_semi").select("conv", "len"))
        limit *= LONGER
        keys = saved(keys.join(longer, "conv", "left_anti").unionByName(_keyed(longer, turns.join(longer.select("conv"), "conv", "left_semi"), limit)))


def _shared(a: str, b: str) -> int:
    """Turns that two keys begin with alike."""
    if a == b:
        return len(a) // _NAME
    lo, hi = 0, min(len(a), len(b)) // _NAME
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[(lo * _NAME) : mid * _NAME] == b[(lo * _NAME) : mid * _NAME] else (lo, mid - 1)
    return lo


_SORTED = pa.schema([("pid", pa.int32()), ("at", pa.int64()), ("conv", pa.int64()), ("len", pa.int64()), ("lcp", pa.int64()), ("key", pa.string())])


def _sorted(keys: DataFrame) -> DataFrame:
    """pid, at (place in the partition), conv, len, lcp (with the row before; null in a partition's first), key (in its first and last row only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, last, rows = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for conv, size, key in zip(*[b.column(c).to_pylist() for c in ("conv", "len", "key")], strict=True):
                rows.append([pid, at, conv, size, None if last is None else _shared(last, key), None if at else key])
                at, last = at + 1, key
            if len(rows) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:-1], strict=True), _SORTED.types, strict=True)], schema=_SORTED)
                rows = rows[-1:]
        if rows:
            rows[0][-1] = last
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(rows[0], _SORTED.types, strict=True)], schema=_SORTED)

    dealt = keys.repartitionByRange(partitions(keys.sparkSession), "key", "conv").sortWithinPartitions("key", "conv")
    return dealt.select("conv", "len", "key").mapInArrow(run, "pid int, at long, conv long, len long, lcp long, key string")


@dataclass(frozen=True)
class Blocks:
    """A number or two for each block of the sorted conversations: its place, its first LCP value and the next block's, its least LCP value and conv."""

    pids: tuple[int, ...]
    begins: tuple[int, ...]
    firsts: tuple[int, ...]
    least: tuple[int, ...]
    convs: tuple[int, ...]
    size: int

    @staticmethod
    def of(rows: DataFrame) -> Blocks:
        """Read once from _sorted(): two keys and a few numbers for each partition."""
        sums = {r["pid"]: r for r in rows.groupBy("pid").agg(F.count("*").alias("n"), F.min("lcp").alias("least"), F.min("conv").alias("conv")).collect()}
        edges: dict[int, list[str]] = {}
        for r in rows.where("key is not null").orderBy("pid", "at").select("pid", "key").collect():
            edges.setdefault(r["pid"], []).append(r["key"])
        pids = sorted(sums)
        firsts = [-1, *[_shared(edges[a][-1], edges[b][0]) for a, b in zip(pids, pids[1:], strict=False)]][: len(pids)]
        least = [f if sums[p]["least"] is None else min(f, sums[p]["least"]) for f, p in zip(firsts, pids, strict=True)]
        begins = np.cumsum([0, *[sums[p]["n"] for p in pids]]).tolist()
        return Blocks(tuple(pids), tuple(begins[:-1]), tuple(firsts), tuple(least), tuple(sums[p]["conv"] for p in pids), begins[-1])


class _Least:
    """The least of any stretch of an array, by minima of stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows, step = [values], 1
        while 2 * step <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of values[lo:hi] for arrays of bounds, lo < hi."""
        out, k = np.empty(len(lo), np.int64), np.log2(hi - lo).astype(np.int64)
        for i in np.unique(k):
            at = k == i
            out[at] = np.minimum(self.rows[i][lo[at]], self.rows[i][hi[at] - (1 << i)])
        return out


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value the nearest place before it that has a smaller one, or -1."""
    out, stack = np.empty(len(values), np.int64), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][1] >= v:
            stack.pop()
        out[i] = stack[-1][0] if stack else -1
        stack.append((i, v))
    return out


#: What a block tells: nodes (0), records for blocks after it (1) and before it (2), conversations that end alone (3), ids that end at a node (4).
_TOLD = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("b", "v", "l", "ll", "lp", "lb", "r", "rl", "rb", "conv", "m")], ("ids", pa.string())])
_TOLD_SQL = "kind int, " + ", ".join(f"{c} long" for c in _TOLD.names[1:-1]) + ", ids string"


def told(b: int, conv: np.ndarray, length: np.ndarray, lcp: np.ndarray, blocks: Blocks) -> Iterator[tuple]:
    """Rows of _TOLD of block b, whose conversations have these lengths and LCP values.

    l and r are the nearest smaller values' places on both sides (r may be the
    array's size), ll and rl those values, lp the nearest smaller before l. A
    null l or lp is found by the records of an earlier block: the one in lb, or
    what node (b, value) of this block finds. A null r likewise in block rb.
    """
    n, begin, last = len(conv), blocks.begins[b], b + 1 == len(blocks.begins)
    low, lows = np.array(blocks.least), np.array(blocks.convs)
    before = smaller_before(lcp)
    after = n - 1 - smaller_before(lcp[::-1])[::-1]  # n: none in this block
    least = _Least(conv)
    place = lambda i: begin + i if i >= 0 else None
    own = np.nonzero(lcp >= 0)[0]
    if len(own):
        # values with one place before them and one value are one node
        _, at, m = np.unique(np.stack((before[own], lcp[own])), axis=1, return_index=True, return_counts=True)
        at = own[at]
        mins = least.of(np.maximum(before[at], 0), after[at])
        for i, c, count in zip(at.tolist(), mins.tolist(), m.tolist(), strict=True):
            v, l, r, lb, rb, rl = int(lcp[i]), int(before[i]), int(after[i]), None, None, None
            if l < 0:
                lb = int(np.nonzero(low[:b] < v)[0][-1])
                c = min([c, *lows[lb + 1 : b].tolist()])
            if r < n:
                right, rl = begin + r, int(lcp[r])
            else:
                past = np.nonzero(low[b + 1 :] < v)[0]
                if len(past):
                    right, rb = None, b + 1 + int(past[0])
                else:
                    right, rl = blocks.size, -1
                c = min([c, *lows[b + 1 : len(lows) if rb is None else rb].tolist()])
            yield 0, b, v, place(l), int(lcp[l]) if l >= 0 else None, place(int(before[l])) if l >= 0 else None, lb, right, rl, rb, c, count, None
    suffix, prefix = np.minimum.accumulate(conv[::-1])[::-1], np.minimum.accumulate(conv)
    for i in np.nonzero(lcp < np.concatenate((np.minimum.accumulate(lcp[::-1])[::-1][1:], [1 << 62])))[0].tolist():
        yield 1, b, int(lcp[i]), begin + i, None, place(int(before[i])), None, None, None, None, int(suffix[i]), None, None
    for i in np.nonzero(lcp < np.concatenate(([1 << 62], np.minimum.accumulate(lcp)[:-1])))[0].tolist():
        yield 2, b, int(lcp[i]), None, None, None, None, begin + i, None, None, int(prefix[i - 1]) if i else None, None, None
    then = np.concatenate((lcp[1:], [-1 if last else blocks.firsts[b + 1]]))
    alone = length > np.maximum(lcp, then)
    for i in np.nonzero(alone)[0].tolist():
        yield 3, b, int(length[i]), begin + i, int(lcp[i]), place(int(before[i])), None, begin + i + 1, int(then[i]), None, int(conv[i]), None, None
    ends = np.nonzero(~alone)[0].tolist()
    for run in _runs(ends, lcp, length):
        for k in range(0, len(run), _IDS):
            part, i = run[k : k + _IDS], run[0]
            goes_on = lcp[i] == length[i]
            yield 4, b, int(length[i]), place(int(before[i])) if goes_on else begin + i, None, None, None, begin + part[0], None, None, None, len(part), ",".join(map(str, conv[part].tolist()))


def _runs(ends: list[int], lcp: np.ndarray, length: np.ndarray) -> Iterator[list[int]]:
    """Stretches of places whose conversations are the same: their LCP value is the length of both."""
    run: list[int] = []
    for i in ends:
        if run and not (run[-1] == i - 1 and lcp[i] == length[i] == length[i - 1]):
            yield run
            run = []
        run.append(i)
    if run:
        yield run


def _blockwise(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """told() of every block."""
    of = {p: b for b, p in enumerate(blocks.pids)}

    def done(held: list[tuple], pid: int) -> Iterator[pa.RecordBatch]:
        conv, length, lcp = (np.array(x, np.int64) for x in zip(*held, strict=True))
        lcp[0] = blocks.firsts[of[pid]]
        out: list[tuple] = []
        for row in told(of[pid], conv, length, lcp, blocks):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TOLD.types, strict=True)], schema=_TOLD)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TOLD.types, strict=True)], schema=_TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for pid, conv, length, lcp in zip(*[b.column(c).to_pylist() for c in ("pid", "conv", "len", "lcp")], strict=True):
                if held and pid != now:
                    yield from done(held, now)
                    held = []
                now = pid
                held.append((conv, length, -1 if lcp is None else lcp))
        if held:
            yield from done(held, now)

    dealt = rows.select("pid", "at", "conv", "len", "lcp").repartition(partitions(rows.sparkSession), "pid").sortWithinPartitions("pid", "at")
    return dealt.mapInArrow(run, _TOLD_SQL)


def places_before(told_: DataFrame) -> DataFrame:
    """b, v, f (l, ll, lp, conv, lb): for a value v that has no smaller one before it in block b, the record of an earlier block."""
    asked, records = told_.where("kind = 0 and l is null").select("b", "v", "lb").distinct().alias("q"), told_.where("kind = 1").alias("x")
    met = asked.join(records, (F.col("q.lb") == F.col("x.b")) & (F.col("x.v") < F.col("q.v")))
    found = F.struct("x.l", F.col("x.v").alias("ll"), F.col("x.lp").alias("lp"), F.col("x.conv").alias("conv"), F.col("q.lb").alias("lb"))
    return met.groupBy("q.b", "q.v").agg(F.max(found).alias("f")).select("b", "v", "f")


def places_after(told_: DataFrame) -> DataFrame:
    """b, v, g (r, rl, conv): likewise after it."""
    asked, records = told_.where("kind = 0 and r is null").select("b", "v", "rb").distinct().alias("q"), told_.where("kind = 2").alias("x")
    met = asked.join(records, (F.col("q.rb") == F.col("x.b")) & (F.col("x.v") < F.col("q.v")))
    return met.groupBy("q.b", "q.v").agg(F.min(F.struct("x.r", F.col("x.v").alias("rl"), F.col("x.conv").alias("conv"))).alias("g")).select("b", "v", "g")


def chains(told_: DataFrame, before: DataFrame) -> DataFrame:
    """l, r, bottom, top, conv, n, children, parent (where its node begins), alone: unbranched stretches of depths top to bottom over the sorted places l to r - 1."""
    node, alone, ends = (told_.where(F.col("kind") == k) for k in (0, 3, 4))
    after = places_after(told_)
    known = node.join(before, ["b", "v"], "left").join(after, ["b", "v"], "left")
    # another node of the same block and value may have both places inside
    both = known.select(
        "v", F.coalesce("l", "f.l").alias("l"), F.coalesce("ll", "f.ll").alias("ll"), F.when(F.col("l").isNull(), F.col("f.lp")).otherwise(F.col("lp")).alias("lp"), F.when(F.col("l").isNull(), F.col("f.lb")).otherwise(F.col("b")).alias("of"),
        F.coalesce("r", "g.r").alias("r"), F.coalesce("rl", "g.rl").alias("rl"), F.least("conv", F.when(F.col("l").isNull(), F.col("f.conv")), F.when(F.col("r").isNull(), F.col("g.conv"))).alias("conv"), "m",
    )
    inner = both.groupBy("v", "l", "r", "ll", "rl", "lp").agg(F.min("of").alias("of"), F.min("conv").alias("conv"), F.sum("m").alias("m"))
    start = before.select(F.col("b").alias("of"), F.col("v").alias("ll"), F.col("f.l").alias("found"))
    leaf = alone.select("v", "l", "r", "ll", "rl", "lp", F.col("b").alias("of"), "conv", F.lit(None).cast("long").alias("m"))
    each = inner.unionByName(leaf).join(start, ["of", "ll"], "left")
    parent = F.when(F.col("ll") < F.col("rl"), F.col("l")).otherwise(F.coalesce("lp", "found"))
    ended = _ends(ends, before).groupBy("l", "v").agg(F.sum("m").alias("ended"))
    return each.join(ended, ["l", "v"], "left").select(
        "l", "r", F.col("v").alias("bottom"), (F.greatest("ll", "rl") + 1).alias("top"), "conv", (F.col("r") - F.col("l")).alias("n"),
        F.when(F.col("m").isNull(), F.lit(0)).otherwise(F.col("m") + 1 - F.coalesce("ended", F.lit(0))).alias("children"), parent.alias("parent"), F.col("m").isNull().alias("alone"),
    )


def _ends(ends: DataFrame, before: DataFrame) -> DataFrame:
    """l, v, r (where they stand), m, ids of conversations that end at the node (l, v)."""
    return ends.drop("lb").join(before, ["b", "v"], "left").select(F.coalesce("l", "f.l").alias("l"), "v", "r", "m", "ids")


def _hashes(ends: DataFrame) -> DataFrame:
    """l, v, ends_sha256: ids in order, comma-joined, as a stream."""
    schema = pa.schema([("l", pa.int64()), ("v", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for b in batches:
            for l, v, ids in zip(*[b.column(c).to_pylist() for c in ("l", "v", "ids")], strict=True):
                if (l, v) != now:
                    if now:
                        out.append((*now, h.hexdigest()))
                    now, h = (l, v), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
        if now:
            out.append((*now, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    dealt = ends.repartition(partitions(ends.sparkSession), "l", "v").sortWithinPartitions("l", "v", "r")
    return dealt.select("l", "v", "ids").mapInArrow(run, "l long, v long, ends_sha256 string")


_NONE = hashlib.sha256(b"").hexdigest()


def trie(conversations: DataFrame, first: int = FIRST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node.

    Turns of one place (equal or null turn numbers) are ordered by role, then
    text; null roles and texts are empty, null turns come first. Repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation.
    Columns other than conv_id, turn, role and text are not read. An empty
    table gives no rows, not even a root.
    """
    with scratch(conversations.sparkSession):
        convs, turns = rebuilt(conversations)
        rows = saved(_sorted(sort_keys(convs, turns, first)))
        blocks = Blocks.of(rows)
        all_ = saved(_blockwise(rows, blocks))
        before = saved(places_before(all_))
        chain = saved(chains(all_, before))
        inner = chain.where("not alone")
        # every depth of a stretch that several conversations share, with the text bytes down to it
        deep = inner.select("l", "bottom", "conv", "n", F.explode(F.sequence("top", "bottom")).alias("depth"))
        texts = turns.select("conv", (F.col("pos") + 1).alias("depth"), "below", (F.col("below") + F.col("bytes")).alias("through"))
        deep = saved(deep.join(texts, ["conv", "depth"], "left"))
        weight = deep.groupBy("l", "bottom").agg(F.max("through").alias("through"), F.min("below").alias("below"))
        own = chain.join(weight, ["l", "bottom"], "left").select(*chain.columns, F.col("through").alias("end"), F.coalesce((F.col("n") - 1) * (F.col("through") - F.col("below")), F.lit(0)).alias("weight"), (F.col("children") == 0).cast("long").alias("leaf"))
        order = [F.col("l"), F.col("bottom")]
        pre = saved(_numbered(own, order, order, None, [_Sum("leaf", "leaves"), _Sum("weight", "weights")]))
        total = pre.agg(F.sum("leaf"), F.sum("weight")).first()
        starts = pre.groupBy("l").agg(F.min("leaves").alias("l1"), F.min("weights").alias("w1")).withColumnRenamed("l", "r")
        within = pre.where("not alone").join(starts, "r", "left").withColumns({"n_leaves": F.coalesce("l1", F.lit(total[0])) - F.col("leaves"), "under": F.coalesce("w1", F.lit(total[1])) - F.col("weights") - F.col("weight")})
        above = inner.select(F.col("l").alias("parent"), (F.col("bottom") + 1).alias("top"), F.col("conv").alias("parent_conv"))
        hashed = _hashes(_ends(all_.where("kind = 4"), before)).select("l", F.col("v").alias("bottom"), "ends_sha256")
        shared = within.join(above, ["parent", "top"], "left").join(hashed, ["l", "bottom"], "left").select("l", "bottom", "top", "children", "n_leaves", "under", "end", "parent_conv", "ends_sha256")
        at_bottom, at_top = F.col("depth") == F.col("bottom"), F.col("depth") == F.col("top")
        several = deep.join(shared, ["l", "bottom"]).select(
            F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.when(at_top, F.col("parent_conv")).otherwise(F.col("conv"))).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(at_bottom, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
            (F.col("under") + (F.col("n") - 1) * F.coalesce(F.col("end") - F.coalesce("below", F.lit(0)), F.lit(0))).alias("saved_tokens"), F.coalesce(F.when(at_bottom, F.col("ends_sha256")), F.lit(_NONE)).alias("ends_sha256"),
        )
        single = chain.where("alone").join(above, ["parent", "top"], "left").select("conv", "top", "bottom", "parent_conv", F.explode(F.sequence("top", "bottom")).alias("depth")).select(
            F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.when(at_top, F.col("parent_conv")).otherwise(F.col("conv"))).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            F.when(at_bottom, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(at_bottom, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NONE)).alias("ends_sha256"),
        )
        return saved(several.unionByName(single), outlives=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: Every prefix of every rebuilt conversation is a row.
ORACLE_SQL = """
WITH ids AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, c - c % 5 AS c0, (xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, CASE WHEN p % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 9)::BIGINT AS h FROM ids),
t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
r AS (
  SELECT h.c, t.p, x FROM h JOIN t ON t.c = h.c0 AND t.p < h.h
  UNION ALL SELECT h.c, t.p - h.h + least(h.h, coalesce(n.n, 0)), x FROM h JOIN t ON t.c = h.c AND t.p >= h.h LEFT JOIN n ON n.c = h.c0),
seq AS (SELECT h.c, coalesce(list(x ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s FROM h LEFT JOIN r ON h.c = r.c GROUP BY h.c),
pre AS (SELECT c, d, s, len(s) AS m, sha256(to_json(s[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(to_json(s[1:d - 1])::VARCHAR) END AS up FROM seq, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
node AS (
  SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(strlen(s[d].t)), 0) AS b,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE m = d), '')) AS ends_sha256
  FROM pre GROUP BY d, k),
kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT pre.k, count_if(kids.k IS NULL) AS n_leaves, sum((node.n_convs - 1) * node.b) AS saved_tokens
  FROM node JOIN pre ON pre.c = node.conv_id AND pre.d <= node.d LEFT JOIN kids ON kids.k = node.k GROUP BY pre.k)
SELECT node.conv_id, node.d AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN below ON below.k = node.k LEFT JOIN kids ON kids.k = node.k LEFT JOIN node above ON above.k = node.up
"""
