"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded, hash-ordered sample of the rows whose labels may be
learnt from. Every term of an example is a term of the vectors, none is left
out; document frequencies are counted over all documents. A text's other words
stand in no example, so they enter no product and no norm. The examples' unit
vectors are kept in an inverted index whose postings lie in blocks of example
numbers, each with the largest weight of the block. The commonest terms stand in
nearly every block, where a largest weight says little: their share of the
cosines is a matrix product. The k-th best share is a lower bound of the k-th
best cosine, and only blocks whose best share with the largest weights of the
other terms reaches it are looked into. So the neighbours are those of a full
scan, ties going to the lower example number.

Neighbours vote with a power of their cosine as weight, in neighbourhoods of
several sizes: few near ones know copies and rare words, many know the words
that labelled texts have in common. A logistic curve, fitted to the examples'
leave-one-out votes, turns the votes into a probability. The nearest neighbours
are returned as evidence.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import islice
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, learns, mapped, partitions, saved, scratch, table

#: Examples at most; neighbours that are evidence; examples in a block.
EXAMPLES, NEIGHBOURS, BLOCK = 8192, 15, 256
#: Neighbourhoods that vote, and powers of the cosine that weigh the votes.
SIZES, POWERS = (7, 31, 127, 511), (1, 3)
#: Share of the examples from which a term is common; texts searched together; texts whose neighbours a task remembers.
COMMON, TOGETHER, REMEMBERED = 1 / 16, 64, 20_000
#: Weight of the base rate among the votes; pull of the curve towards flat.
PRIOR_WEIGHT, RIDGE = 1e-3, 0.1
THRESHOLD = 0.3
_TERM = re.compile(r"[^\W\d_]+")
Vector = tuple[np.ndarray, np.ndarray]


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of count[0] numbers, then those of the next."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """Block-max inverted index of unit vectors.

    Postings (term, example, count, weight) are sorted by term and example. An
    entry is the run of one term's postings in one block: where it begins, its
    block and its largest weight; entries of a term are contiguous too.
    """

    number: dict[str, int]
    idf: list[float]
    ids: list[int]
    labels: np.ndarray
    term: np.ndarray
    example: np.ndarray
    count: np.ndarray

    def __post_init__(self) -> None:
        self.idf = np.array(self.idf, float)
        raw = (1 + np.log(self.count)) * self.idf[self.term]
        norm = np.sqrt(np.bincount(self.example, raw * raw, len(self.ids)))
        self.weight = raw / np.where(norm > 0, norm, 1)[self.example]
        self.blocks = -(-len(self.ids) // BLOCK)
        block = self.example // BLOCK
        starts = np.nonzero(np.diff(self.term.astype(np.int64) * (self.blocks + 1) + block, prepend=-1))[0]
        self.begin, self.block = np.append(starts, len(self.term)), block[starts]
        self.most = np.maximum.reduceat(self.weight, starts) if len(starts) else self.weight
        self.entries = np.searchsorted(self.term[starts], np.arange(len(self.number) + 1))
        often = np.nonzero(np.bincount(self.term, minlength=len(self.number)) > COMMON * len(self.ids))[0]
        self.row = np.full(len(self.number), -1)
        self.row[often] = np.arange(len(often))
        self.common = np.zeros((len(often), self.blocks * BLOCK))
        own = self.row[self.term] >= 0
        self.common[self.row[self.term[own]], self.example[own]] = self.weight[own]

    def __reduce__(self) -> tuple:
        """What is sent to the tasks: counts, packed; weights and entries are made again there."""
        size = np.bincount(self.term, minlength=len(self.number))
        return _unpacked, (zlib.compress(pickle.dumps((list(self.number), self.idf.tolist(), self.ids, self.labels, size.astype(np.uint32), self.example.astype(np.uint32), self.count.astype(np.uint32))), 1),)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> Vector:
        """Term numbers and the weights of a unit vector."""
        raw = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt(raw @ raw)
        return terms, raw / norm if norm else raw

    def vector_of(self, text: str | None) -> Vector:
        return self.vector(*_known(text, self.number))

    @classmethod
    def build(cls, number: dict[str, int], idf: list[float], examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Index:
        """examples: (doc_id, label, term numbers, their counts), numbered in their order."""
        none = np.zeros(0, np.int64)
        term, count = np.concatenate([none, *(e[2] for e in examples)]), np.concatenate([none, *(e[3] for e in examples)])
        example = np.repeat(np.arange(len(examples)), np.array([len(e[2]) for e in examples], int))
        order = np.lexsort((example, term))
        return cls(number, idf, [e[0] for e in examples], np.array([e[1] for e in examples], float), term[order].astype(np.int32), example[order].astype(np.int32), count[order].astype(np.int32))

    def nearest(self, queries: list[Vector], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cosines, examples) of each query's k largest positive cosines, largest first, ties by example number."""
        many = np.zeros((len(queries), len(self.common)))
        rest = []
        for j, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            many[j, row[row >= 0]] = weights[row >= 0]
            rest.append((terms[row < 0], weights[row < 0]))
        shares = many @ self.common
        return [self._best(share, *r, k, x) for share, r, x in zip(shares, rest, without or [-1] * len(queries), strict=True)]

    def _best(self, share: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best from the examples' shares by common terms and a query's other terms."""
        if not self.blocks:
            return np.zeros(0), np.zeros(0, np.int64)
        if without >= 0:
            share[without] = -9.0  # below all, whatever its other terms add
        n = self.entries[terms + 1] - self.entries[terms]
        entry, w = _ranges(self.entries[terms], n), np.repeat(weights, n)
        block = self.block[entry]
        bound = share.reshape(self.blocks, BLOCK).max(1) + np.bincount(block, w * self.most[entry], self.blocks)
        least = np.partition(share, len(share) - k)[len(share) - k] if len(share) > k else 0.0
        # cosines are rounded to nine digits, so a block less than that below the k-th may still tie
        visit = (bound > 0) & (bound >= least - 1e-9)
        own = visit[block]
        e = entry[own]
        n = self.begin[e + 1] - self.begin[e]
        posting = _ranges(self.begin[e], n)
        scores = share + np.bincount(self.example[posting], np.repeat(w[own], n) * self.weight[posting], len(share))
        found = np.nonzero((scores > 5e-10) & (scores >= least - 1e-9) & np.repeat(visit, BLOCK))[0]
        cosine = np.round(scores[found], 9)
        if len(found) > k:
            keep = cosine >= np.partition(cosine, len(cosine) - k)[len(cosine) - k]
            cosine, found = cosine[keep], found[keep]
        best = np.lexsort((found, -cosine))[:k]
        return cosine[best], found[best]

    def votes(self, near: tuple[np.ndarray, np.ndarray], base: float) -> list[float]:
        """Log odds of the weighted votes of each neighbourhood; without neighbours those of the base rate."""
        out = []
        for power in POWERS:
            weight = near[0] ** power
            all_, for_ = np.cumsum(weight), np.cumsum(weight * self.labels[near[1]])
            for size in SIZES:
                n = min(size, len(weight))
                rate = ((for_[n - 1] if n else 0.0) + PRIOR_WEIGHT * base) / ((all_[n - 1] if n else 0.0) + PRIOR_WEIGHT)
                rate = min(max(rate, 1e-4), 1 - 1e-4)
                out.append(log(rate / (1 - rate)))
        return out


def _unpacked(state: bytes) -> Index:
    terms, idf, ids, labels, size, example, count = pickle.loads(zlib.decompress(state))
    return Index({t: i for i, t in enumerate(terms)}, idf, ids, labels, np.repeat(np.arange(len(size), dtype=np.int32), size), example.astype(np.int32), count.astype(np.int32))


def _known(text: str | None, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, rising, and counts of the terms of a text that have a number."""
    counts = Counter(terms_of(text))
    found = [(i, n) for t, n in counts.items() if (i := number.get(t)) is not None]
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the columns of x and, last, a constant, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


@dataclass
class Model:
    index: Index
    base: float
    weights: np.ndarray

    def score(self, near: tuple[np.ndarray, np.ndarray]) -> float:
        if not len(self.weights):
            return self.base
        z = float(np.dot(self.weights[:-1], self.index.votes(near, self.base)) + self.weights[-1])
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9)


def examples_of(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> DataFrame:
    """(doc_id, text, toxic) of at most `bound` labelled documents, the first by a hash of their id.

    Several labels of one document count as their maximum, of several texts
    under one id the smallest is taken.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learns(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # the sample has at most `bound` rows, so it may be broadcast
    few = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


_VECTOR = "doc_id long, terms array<int>, counts array<int>"


def vectors_of(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """doc_id, terms, counts: the numbers and counts of each whole text's known terms, one row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(number)  # terms of the examples, which are bounded

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        known = shared.value
        for r in each:
            yield r["doc_id"], *_known(r["text"], known)

    return mapped(docs.select("doc_id", "text"), _VECTOR, rows)


def frequencies(vectors: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many rows each of `size` terms stands, and the number of rows."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(size, np.int64), 0
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
            rows += b.num_rows
        term = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1).astype(np.int32)), pa.array(np.append(n[term], rows))], schema=schema)

    # a row for each term of the examples at most comes to the driver
    counted = vectors.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, term, n = np.zeros(size + 1, np.int64), counted["term"].to_numpy(), counted["n"].to_numpy()
    out[term] = n
    return out[:size], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> tuple[Model, DataFrame]:
    """A model learnt from the examples, with document frequencies of all of `docs`, and vectors_of(docs) as a table."""
    spark = docs.sparkSession
    with scratch(spark):
        sample = saved(examples_of(docs, labels, bound))

        def words(each: Iterator[dict]) -> Iterator[tuple]:
            for t in {t for r in each for t in terms_of(r["text"])}:
                yield (t,)

        number = {t: i for i, t in enumerate(sorted(mapped(sample.select("text"), "term string", words).distinct().toArrow()["term"].to_pylist()))}
        vectors = saved(vectors_of(docs, number), outlives=True)
        df, total = frequencies(vectors, len(number))
        got = vectors_of(sample, number).join(sample.select("doc_id", "toxic"), "doc_id").toArrow().sort_by("doc_id")
        ids, toxic = got["doc_id"].to_pylist(), got["toxic"].to_pylist()
        if not ids:
            return Model(Index.build({}, [], []), 0.0, np.zeros(0)), vectors
        idf = np.log((1 + total) / (1 + df)).tolist()
        flat = [(np.array(t, np.int64), np.array(c, np.int64)) for t, c in zip(got["terms"].to_pylist(), got["counts"].to_pylist(), strict=True)]
        index = Index.build(number, idf, [(i, y, *v) for i, y, v in zip(ids, toxic, flat, strict=True)])
        base = sum(toxic) / len(toxic)
        sent = spark.sparkContext.broadcast((index, {d: i for i, d in enumerate(ids)}))

        def voted(each: Iterator[dict]) -> Iterator[tuple]:
            index, place = sent.value
            while some := list(islice(each, TOGETHER)):
                found = index.nearest([index.vector_of(r["text"]) for r in some], max(SIZES), [place[r["doc_id"]] for r in some])
                for r, near in zip(some, found, strict=True):
                    yield r["doc_id"], index.votes(near, base)

        votes = mapped(sample.select("doc_id", "text").repartition(partitions(spark)), "doc_id long, votes array<double>", voted).toArrow().sort_by("doc_id")["votes"].to_pylist()
        sent.destroy()
        return Model(index, base, logistic(np.array(votes), np.array(toxic, float))), vectors


def scored(vectors: DataFrame, model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, evidence (doc_ids of the k nearest examples, nearest first) of every row of vectors_of().

    Null and empty texts have no neighbours and get the score of the base rate.
    Rows are one to one with the input's.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        m = shared.value
        memo: dict[bytes, tuple] = {}
        while some := list(islice(each, TOGETHER)):
            pairs = [(np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in some]
            keys = [hash_of(*p) for p in pairs]
            if len(memo) > REMEMBERED:
                memo.clear()
            new = {key: p for key, p in zip(keys, pairs, strict=True) if key not in memo}
            found = m.index.nearest([m.index.vector(*p) for p in new.values()], max(k, *SIZES))
            memo.update((key, (m.score(near), [m.index.ids[i] for i in near[1][:k]])) for key, near in zip(new, found, strict=True))
            for key, r in zip(keys, some, strict=True):
                yield r["doc_id"], *memo[key]

    return mapped(vectors.select("doc_id", "terms", "counts"), "doc_id long, score double, evidence array<long>", rows)


def hash_of(terms: np.ndarray, counts: np.ndarray) -> bytes:
    return blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, vectors = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(vectors, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
