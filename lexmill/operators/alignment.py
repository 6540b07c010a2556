"""Letters aligned with the sounds they stand for, learnt over many words by expectation and best paths.

Each word is a lattice: a letter takes the next 0, 1 or 2 sounds. Words are
worked out in Arrow batches, those of one shape (as many letters, as many
sounds) together; counts of (letter, sounds) are summed by a shuffle and are
all that reaches the driver, as many as two alphabets have pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .common import settled

Output = tuple[str, ...]
Scores = dict[tuple[str, Output], float]
#: Pairs of a letter and sounds that are learnt at most; more are no alphabets.
MOST_PAIRS = 1_000_000
#: Places of all lattices that are worked out at a time, and possible pairs of a batch up to which they are laid out in one array.
CELLS, DENSE = 1 << 20, 1 << 18
_COUNTS = "letter string, sounds array<string>, n double, score double"


class _Batch:
    """Words whose letters can take all sounds, as numbers. A pair of a letter and 0, 1 or 2 sounds is one number, its key."""

    def __init__(self, letters: pa.Array, sounds: pa.Array):
        self.letters, self.own, self.n = _coded(letters)
        self.sounds, self.said, self.m = _coded(sounds)
        #: Sounds count from 1 in keys, 0 is none.
        self.base = len(self.sounds) + 1
        self.keys = len(self.letters) * self.base**2

    def shapes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of words of one shape at a time: their numbers, places of their letters and places of their sounds, a row for each word."""
        order = np.lexsort((self.m, self.n))
        first, begin = np.cumsum(self.n) - self.n, np.cumsum(self.m) - self.m
        for same in np.split(order, np.flatnonzero(np.diff(self.n[order]) | np.diff(self.m[order])) + 1):
            if len(same):
                n, m = self.n[same[0]], self.m[same[0]]
                step = max(1, CELLS // int((n + 1) * (m + 1)))
                for part in (same[i : i + step] for i in range(0, len(same), step)):
                    yield part, first[part][:, None] + np.arange(n), begin[part][:, None] + np.arange(m)

    def runs(self, at: np.ndarray) -> list[np.ndarray]:
        """What one and two sounds that begin at each place add to the key of a letter."""
        said = self.said[at] + 1
        return [said * self.base, said[:, :-1] * self.base + said[:, 1:]]

    def pairs(self, counts: tuple[np.ndarray, np.ndarray]) -> list[tuple[str, list[str], float]]:
        """Letter, sounds and count of keys and their counts."""
        keys, n = counts
        letter, run = np.divmod(keys, self.base**2)
        a, b = np.divmod(run, self.base)
        return [(self.letters[i], [self.sounds[x - 1] for x in (j, k) if x], c) for i, j, k, c in zip(letter.tolist(), a.tolist(), b.tolist(), n.tolist(), strict=True)]


def _coded(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct items of all lists, the number of each item among them, and the size of each list."""
    flat = pc.list_flatten(lists).dictionary_encode("encode")
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _alignable(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Without words of which a letter would need more sounds than it can take."""
    most = pc.multiply(pc.list_value_length(batch["letters"]), len(fixed.SOUND_WEIGHTS) - 1)
    return batch.filter(pc.less_equal(pc.list_value_length(batch["sounds"]), most))


class _Counts:
    """Sums by key; what is held stays near CELLS."""

    def __init__(self, keys: int):
        self.keys, self.held, self.size = keys, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.held.append((keys.ravel(), np.broadcast_to(n, keys.shape).ravel()))
        self.size += keys.size
        if self.size > CELLS:
            self.held = [self.summed()]
            self.size = 0

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([x[i] for x in self.held]) if self.held else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.float64)))
        if self.keys > DENSE:
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, n, len(keys))
        n = np.bincount(keys, n)
        keys = np.flatnonzero(n)
        return keys, n[keys]


def _shares(n: int, m: int) -> Iterator[list[np.ndarray]]:
    """For each of n letters and each number of sounds it takes, the share of all weighed ways in which those begin at each of m sounds."""
    weights = np.log(fixed.SOUND_WEIGHTS[: m + 1])
    before, after = np.full((n + 1, m + 1), -np.inf), np.full((n + 1, m + 1), -np.inf)  # logs, as long words have many ways
    before[0, 0] = after[n, m] = 0.0
    for i in range(n):
        for took, weight in enumerate(weights):
            before[i + 1, took:] = np.logaddexp(before[i + 1, took:], before[i, : m + 1 - took] + weight)
    for i in range(n - 1, -1, -1):
        for took, weight in enumerate(weights):
            after[i, : m + 1 - took] = np.logaddexp(after[i, : m + 1 - took], after[i + 1, took:] + weight)
    for i in range(n):
        yield [np.exp(before[i, : m + 1 - took] + weight + after[i + 1, took:] - after[0, 0]) for took, weight in enumerate(weights)]


def _expected(b: _Batch) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs on all ways to align the words, and the share of each, summed over the words."""
    out = _Counts(b.keys)
    for _, own, said in b.shapes():
        (n, m), runs = (own.shape[1], said.shape[1]), [np.zeros((len(own), said.shape[1] + 1), np.int64), *b.runs(said)]
        for i, shares in enumerate(_shares(n, m)):
            letter = b.own[own[:, i]][:, None] * b.base**2
            for run, share in zip(runs, shares, strict=False):
                at = np.flatnonzero(share)
                out.add(letter + run[:, at], share[at])
    return out.summed()


def _scored(b: _Batch, scores: Scores) -> Callable[[np.ndarray], np.ndarray]:
    """A function from keys to scores."""
    letters, sounds = {x: i for i, x in enumerate(b.letters)}, {x: i + 1 for i, x in enumerate(b.sounds)}
    known = {}
    for (letter, said), score in scores.items():
        if letter in letters and all(x in sounds for x in said):
            a, c = (*(sounds[x] for x in said), 0, 0)[:2]
            known[(letters[letter] * b.base + a) * b.base + c] = score
    keys = np.array(sorted(known), np.int64)
    values = np.array([known[k] for k in keys.tolist()], np.float64)
    if b.keys <= DENSE:
        dense = np.full(b.keys, fixed.UNSEEN, np.float64)
        dense[keys] = values
        return lambda at: dense[at]
    keys, values = np.append(keys, -1), np.append(values, fixed.UNSEEN)

    def score(at: np.ndarray) -> np.ndarray:
        place = np.searchsorted(keys[:-1], at)
        return np.where(keys[place] == at, values[place], fixed.UNSEEN)

    return score


def _best(b: _Batch, scores: Scores) -> tuple[np.ndarray, np.ndarray]:
    """How many sounds each letter of all words takes on the likeliest path, and the log likelihood of each word's; of equal ones that on which late letters take fewer."""
    takes, totals, score = np.zeros(len(b.own), np.int64), np.zeros(len(b.n), np.float64), _scored(b, scores)
    for words, own, said in b.shapes():
        (many, n), m, rows = own.shape, said.shape[1], np.arange(len(words))
        runs, back = b.runs(said)[:m], np.zeros((n, many, m + 1), np.int8)
        at = np.full((many, m + 1), -np.inf)
        at[:, 0] = 0.0
        for i in range(n):
            letter = b.own[own[:, i]][:, None] * b.base**2
            now = at + score(letter)
            for took, run in enumerate(runs, 1):
                other = at[:, : m + 1 - took] + score(letter + run)
                better = other > now[:, took:]
                np.copyto(now[:, took:], other, where=better)
                back[i, :, took:][better] = took
            at = now
        totals[words], end = at[:, m], np.full(many, m)
        for i in range(n - 1, -1, -1):
            takes[own[:, i]] = took = back[i, rows, end].astype(np.int64)
            end -= took
    return takes, totals


def _taken(b: _Batch, takes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs on the paths, and how often each stands there. The sounds of all words follow each other as their letters take them."""
    at, said = np.cumsum(takes) - takes, np.append(b.said + 1, [0, 0])
    out = _Counts(b.keys)
    out.add((b.own * b.base + np.where(takes > 0, said[at], 0)) * b.base + np.where(takes > 1, said[at + 1], 0), np.ones(1))
    return out.summed()


def _one(letters: Sequence[str], sounds: Sequence[str]) -> pa.RecordBatch:
    kind = pa.list_(pa.string())
    return _alignable(pa.record_batch([pa.array([list(letters)], kind), pa.array([list(sounds)], kind)], ["letters", "sounds"]))


def expected(letters: Sequence[str], sounds: Sequence[str]) -> Counter:
    """Of all ways to align a word, weighed by how many sounds each letter takes, the share of each (letter, sounds); nothing where there is no way."""
    batch = _one(letters, sounds)
    b = _Batch(batch["letters"], batch["sounds"])
    return Counter({(letter, tuple(said)): n for letter, said, n in b.pairs(_expected(b))})


def best_path(letters: Sequence[str], sounds: Sequence[str], scores: Scores) -> tuple[list[Output], float] | None:
    """The sounds of each letter on the likeliest path, and its log likelihood; of equal ones that on which late letters take fewer. None if a letter would need more than two."""
    batch = _one(letters, sounds)
    if not len(batch):
        return None
    takes, totals = _best(_Batch(batch["letters"], batch["sounds"]), scores)
    ends = np.cumsum(takes).tolist()
    return [tuple(sounds[end - took : end]) for end, took in zip(ends, takes.tolist(), strict=True)], float(totals[0])


def _summed(parts: DataFrame) -> tuple[Scores, float]:
    """Log shares of the sounds of each letter, from counts in parts, and the sum of what is scored."""
    rows = parts.groupBy("letter", "sounds").agg(F.sum("n").alias("n"), F.sum("score").alias("score")).limit(MOST_PAIRS + 2).collect()
    told, rows = math.fsum(r["score"] for r in rows), [r for r in rows if r["sounds"] is not None]
    if len(rows) > MOST_PAIRS:
        raise ValueError("too many pairs of letters and sounds")
    totals: Counter = Counter()
    rows.sort(key=lambda r: (r["letter"], r["sounds"]))
    for r in rows:
        totals[r["letter"]] += r["n"]
    return {(r["letter"], tuple(r["sounds"])): math.log(r["n"] / totals[r["letter"]]) for r in rows}, told


def aligned(words: DataFrame, rounds: int = 10, change: float = 0.001) -> tuple[DataFrame, list[float]]:
    """(word, outputs, score) of the words (word, letters, sounds) that can be aligned, and the log likelihood of each round.

    The first scores count all alignments; each round aligns every word by its
    best path and counts those, until the likelihood changes by `change` of
    itself or less. Repeated words count each time; nulls are left out. Rounds
    pass on counts only; the paths are worked out where the result is read.
    """
    # small rows that take long: not to be gathered in few tasks
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = settled(words.where("letters is not null and sounds is not null").select("word", "letters", "sounds").repartition(spread, "word"))

    def counted(batches: Iterator[pa.RecordBatch], scores: Scores | None) -> Iterator[pa.RecordBatch]:
        for batch in map(_alignable, batches):
            if len(batch):
                b, told = _Batch(batch["letters"], batch["sounds"]), 0.0
                if scores is None:
                    counts = _expected(b)
                else:
                    takes, totals = _best(b, scores)
                    counts, told = _taken(b, takes), float(totals.sum())
                pairs = [(*x, 0.0) for x in b.pairs(counts)] + [(None, None, 0.0, told)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs, strict=True), (pa.string(), pa.list_(pa.string()), pa.float64(), pa.float64()), strict=True)], ["letter", "sounds", "n", "score"])

    def paths(batches: Iterator[pa.RecordBatch], scores: Scores) -> Iterator[pa.RecordBatch]:
        for batch in map(_alignable, batches):
            b = _Batch(batch["letters"], batch["sounds"])
            takes, totals = _best(b, scores)
            ends = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            outputs = pa.ListArray.from_arrays(ends(b.n), pa.ListArray.from_arrays(ends(takes), pc.list_flatten(batch["sounds"])))
            yield pa.RecordBatch.from_arrays([batch["word"], outputs, pa.array(totals)], ["word", "outputs", "score"])

    scores, told = _summed(own.mapInArrow(lambda batches: counted(batches, None), _COUNTS))[0], []
    while True:
        learnt, likelihood = _summed(own.mapInArrow(lambda batches, scores=scores: counted(batches, scores), _COUNTS))
        told.append(likelihood)
        if len(told) >= rounds or len(told) > 1 and abs(told[-1] - told[-2]) <= change * abs(told[-2]):
            return own.mapInArrow(lambda batches, scores=scores: paths(batches, scores), "word string, outputs array<array<string>>, score double"), told
        scores = learnt
