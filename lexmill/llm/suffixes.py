"""Substring dedup of bytes by a logarithmic family of suffix arrays.

Segments that may repeat are dealt to shards (see repeats). In a shard they
come in batches. A batch's suffixes, WIDTH bytes deep, which is all that a
match needs, are sorted to an array of integers, places in the shard's text.
The array is merge-scanned against each level of the family for suffixes that
agree in WIDTH bytes; then it joins the family, and levels of equal size merge,
so n batches leave about log n levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import Windows, byte_tokens, covered, cut_bytes, removed

#: Bytes in a window and in a k-gram; segments in a shard, of one anchor in a shard at most, and in a batch; bands by which larger anchors are split.
WIDTH, GRAM, PER_SHARD, MOST, BATCH, BANDS = 400, 32, 1024, 1024, 128, (64, 8, 1)
#: Suffixes that are compared to their full depth at a time.
_AT_ONCE = 1 << 14


class Family:
    """Levels of suffix arrays over one text: (batches in it, places of its suffixes in order)."""

    def __init__(self, text: bytes, width: int):
        self.width = width
        flat = np.frombuffer(text, np.uint8)
        self.deep = np.lib.stride_tricks.sliding_window_view(flat, width) if len(flat) >= width else np.zeros((0, width), np.uint8)
        self.levels: list[tuple[int, np.ndarray]] = []
        self.matched = np.zeros(len(flat), bool)
        #: The eight bytes at each place as a number.
        self.head = np.zeros(len(flat) + 8, np.uint64)
        if width >= 8:
            for i in range(8):
                self.head[: len(flat) - i] |= flat[i:].astype(np.uint64) << np.uint64(56 - 8 * i)

    def _suffixes(self, places: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.deep[places]).view(f"S{self.width}").ravel()

    def add(self, starts: np.ndarray) -> None:
        """A batch: the suffixes that begin at starts, each with width bytes at least."""
        if not len(starts):
            return
        suffixes = self._suffixes(starts)
        order = np.argsort(suffixes, kind="stable")
        new, suffixes = starts[order].astype(np.int32), suffixes[order]
        same = suffixes[1:] == suffixes[:-1]
        self.matched[new[1:][same]] = self.matched[new[:-1][same]] = True
        del suffixes
        at = None
        for _, level in self.levels:
            at = self._places(level, new)
            self._mark(level, new, at)
        self.levels.append((1, new))
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            # the scan of the last level says where the new suffixes go in it
            at = self._places(b, a) if at is None else at
            self.levels.append((n + m, np.insert(b, at, a)))
            at = None

    def _places(self, level: np.ndarray, new: np.ndarray) -> np.ndarray:
        """For each suffix of a sorted array the number of smaller ones in the level."""
        lo, hi = np.zeros(len(new), np.int64), np.full(len(new), len(level), np.int64)
        if self.width >= 8:
            heads = self.head[level]
            lo, hi = np.searchsorted(heads, self.head[new], "left"), np.searchsorted(heads, self.head[new], "right")
        for depth in range(8, min(40, self.width - 7), 8):
            open_ = np.nonzero(lo < hi)[0]
            want = self.head[new[open_] + depth]
            below = self._bound(lo[open_], hi[open_], lambda i, mid: self.head[level[mid] + depth] < want[i])
            above = self._bound(below, hi[open_], lambda i, mid: self.head[level[mid] + depth] <= want[i])
            lo[open_], hi[open_] = below, above
        open_ = np.nonzero(lo < hi)[0]
        for i in range(0, len(open_), _AT_ONCE):
            part = open_[i : i + _AT_ONCE]
            own = self._suffixes(new[part])
            lo[part] = self._bound(lo[part], hi[part], lambda i, mid: self._suffixes(level[mid]) < own[i])
        return lo

    @staticmethod
    def _bound(lo: np.ndarray, hi: np.ndarray, smaller: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Binary search in each range lo to hi: the first place of which smaller(range numbers, places) is false."""
        lo, hi = lo.copy(), hi.copy()
        while len(i := np.nonzero(lo < hi)[0]):
            mid = (lo[i] + hi[i]) // 2
            up = smaller(i, mid)
            lo[i[up]] = mid[up] + 1
            hi[i[~up]] = mid[~up]
        return lo

    def _mark(self, level: np.ndarray, new: np.ndarray, at: np.ndarray) -> None:
        """Equal suffixes of both arrays match; of several equal ones in the level, all have been marked before."""
        may = np.nonzero(at < len(level))[0]
        may = may[self.head[new[may]] == self.head[level[at[may]]]]
        for i in range(0, len(may), _AT_ONCE):
            part = may[i : i + _AT_ONCE]
            same = part[self._suffixes(new[part]) == self._suffixes(level[at[part]])]
            self.matched[new[same]] = self.matched[level[at[same]]] = True


def matches(segments: list[tuple[int, int, bytes]], width: int = WIDTH, batch: int = BATCH) -> Iterator[np.ndarray]:
    """For each segment (number of places, windows, bytes) which of its windows also start elsewhere."""
    begins = np.cumsum([0, *[len(s[2]) for s in segments]])
    family = Family(b"".join(s[2] for s in segments), width)
    for i in range(0, len(segments), batch):
        family.add(np.concatenate([np.arange(b, b + s[1]) for b, s in zip(begins[i:], segments[i : i + batch], strict=False)]))
    for begin, (number, n, _) in zip(begins, segments, strict=False):
        # a segment of several places is a match of itself
        yield np.ones(n, bool) if number > 1 else family.matched[begin : begin + n]


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at:a])
        at = b
    keep.append(text[at:])
    left = b"".join(keep)
    return len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest()


def without_repeats(docs: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each input row.

    Bytes covered by a string of `width` bytes that also starts elsewhere, in
    any row, are removed; repeated rows are places of their own. Null, empty
    and short texts lose nothing. Columns other than doc_id and text are not
    read; an empty table gives no rows.
    """
    windows = Windows(width, min(GRAM, width), byte_tokens)
    spans = covered(docs, windows, cut_bytes, lambda segments: matches(segments, width), PER_SHARD, most, BANDS)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return removed(docs, spans, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", arrow)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
