"""Substring dedup by repeated-phrase automata.

Segments that may repeat are dealt to shards (see repeats). A shard counts the
digests of its windows of WIDTH words; those found twice or more name its
recurring passages. The passages are compiled to an Aho-Corasick automaton over
word numbers, and every segment of every document streams through it (equal
segments once, with their number). The automaton compares words, so it alone
says where a passage stands; one that it finds in two places or more repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import Windows, _mix, covered, cut_words, removed, window_digests, word_tokens

#: Words in a window and in a k-gram; segments in a shard, and of one anchor in a shard at most; bands by which larger anchors are split.
WIDTH, GRAM, PER_SHARD, MOST, BANDS = 35, 6, 4000, 4096, (8, 1)


def passages(numbers: np.ndarray, starts: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """First places of the windows (of `width` numbers, at `starts`) whose digest is found in two places or more, windows counting by weight."""
    if not len(starts):
        return starts
    digests = window_digests(_mix(numbers.astype(np.uint64) + np.uint64(1)), width)[starts]
    _, at, kind = np.unique(digests, return_index=True, return_inverse=True)
    return starts[at[np.bincount(kind, weights) > 1]]


def locate(segments: list[tuple[int, int, bytes]], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each segment (number of places, windows, words) which of its windows are recurring."""
    known: dict[bytes, int] = {}
    texts = [tuple([known.setdefault(w, len(known)) for w in words.split()]) for _, _, words in segments]
    flat = np.fromiter(chain.from_iterable(texts), np.int64)
    begins = np.cumsum([0, *map(len, texts)])
    starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(b, b + s[1]) for b, s in zip(begins, segments, strict=False))])
    recurring = passages(flat, starts, np.repeat([s[0] for s in segments], [s[1] for s in segments]), width)
    if not len(recurring):
        yield from (np.zeros(n, bool) for _, n, _ in segments)
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    words = flat.tolist()
    for i, at in enumerate(recurring.tolist()):
        automaton.add_word(tuple(words[at : at + width]), i)
    automaton.make_automaton()
    places = np.zeros(len(recurring), np.int64)
    found = []
    for (number, _, _), text in zip(segments, texts, strict=True):
        hits = np.array([(end - width + 1, i) for end, i in automaton.iter(text)], np.int64).reshape(-1, 2)
        np.add.at(places, hits[:, 1], number)
        found.append(hits)
    for (_, n, _), hits in zip(segments, found, strict=True):
        out = np.zeros(n, bool)
        out[hits[places[hits[:, 1]] > 1, 0]] = True
        yield out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = text.split()
    keep, at = [], 0
    for a, b in spans:
        keep += words[at:a]
        at = b
    keep += words[at:]
    return len(words), len(words) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()


def without_repeats(docs: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each input row.

    Words covered by a window that also starts elsewhere, in any row, are
    removed; repeated rows are places of their own. Null, blank and short
    texts lose nothing. Columns other than doc_id and text are not read; an
    empty table gives no rows.
    """
    windows = Windows(width, min(GRAM, width), word_tokens)
    spans = covered(docs, windows, cut_words, lambda segments: locate(segments, width), PER_SHARD, most, BANDS)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return removed(docs, spans, _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string", arrow)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
