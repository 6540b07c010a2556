"""Approximate vector search by learnt cells.

Unit vectors are grouped round centres that Spark learns over all of them; a
query looks into the cells whose centres are nearest and compares exactly
there. Rows of a cell meet its queries by an equal join on the cell, in parts
of bounded size, so a cell that holds a third of all vectors is many groups.
An index is a table (vec_id, cell, embedding) beside its centres, and is
brought up to date by key; nothing else has to be learnt again.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import vectors
from .common import settled

#: Cells at most; rounds of learning; cells that a query looks into, of all, at least.
MOST_CELLS, ROUNDS, PROBES = 4096, 6, 8
_INDEX = "vec_id long, cell int, embedding array<float>"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def learnt(rows: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the vectors (vec_id, embedding): a matrix of at most MOST_CELLS rows, the only thing that reaches the driver.

    They begin as the vectors with the smallest digests of their ids and become
    the means of what is nearest to them; sums are made per batch first.
    """
    held = rows.where("embedding is not null").select("vec_id", "embedding")
    n = cells or min(MOST_CELLS, max(1, isqrt(held.count())))
    centres = np.array([r["embedding"] for r in held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()], float)
    if not len(centres):
        raise ValueError("no vectors to learn from")
    centres = _unit(centres)
    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], centres: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            total, count = np.zeros(centres.shape), np.zeros(len(centres))
            for b in batches:
                if len(b):
                    x = vectors._matrix(b["embedding"])
                    near = (x @ centres.T).argmax(axis=1)
                    np.add.at(total, near, x)
                    count += np.bincount(near, minlength=len(centres))
            own = np.nonzero(count)[0]
            if len(own):
                yield pd.DataFrame({"cell": own, "total": list(total[own])})

        parts = held.mapInPandas(sums, "cell int, total array<double>").select("cell", F.posexplode("total").alias("i", "x"))
        new = centres.copy()
        for r in parts.groupBy("cell", "i").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("x")).collect():  # a row for each cell
            new[r["cell"]] = [y["x"] for y in r["x"]]
        centres = _unit(new)
    return centres


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, cell, embedding: each vector with its nearest centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b["vec_id"], "cell": (vectors._matrix(b["embedding"]) @ centres.T).argmax(axis=1), "embedding": b["embedding"]})

    return rows.where("embedding is not null").select("vec_id", "embedding").mapInPandas(run, _INDEX)


def updated(index: DataFrame, centres: np.ndarray, changed: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The index after vectors were added or replaced (vec_id, embedding) and removed (vec_id); the others are not read."""
    for gone in (x.select("vec_id") for x in (changed, removed) if x is not None):
        index = index.join(gone.distinct(), "vec_id", "left_anti")
    return index if changed is None else index.unionByName(assigned(changed, centres))


def nearest(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = PROBES, others_only: bool = False) -> DataFrame:
    """query_id, vec_id, cosine, rank, scanned of the k nearest in the cells that each query looks into, ties at the cut kept; scanned is how many vectors the query was held against."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = min(probes, len(centres))
        for b in batches:
            if len(b):
                near = np.argpartition(-(vectors._matrix(b["embedding"]) @ centres.T), size - 1, axis=1)[:, :size]
                yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), size), "cell": near.ravel(), "embedding": b["embedding"].repeat(size).to_numpy()})

    asked = settled(queries.where("embedding is not null").select("query_id", "embedding").mapInPandas(probe, "query_id long, cell int, embedding array<float>"))
    sizes = settled(index.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / vectors.PART).cast("int")))
    own = index.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    theirs = asked.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.join(theirs.select("cell", "part").distinct(), ["cell", "part"], "left_semi")

    def meet(rows: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or q.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        return pd.concat(list(vectors._tiles(rows, q["query_id"].to_numpy(), vectors._matrix(q["embedding"]), k + others_only, -2.0)))

    found = own.groupBy("cell", "part").cogroup(theirs.groupBy("cell", "part")).applyInPandas(meet, vectors._FOUND)
    if others_only:
        found = found.where("query_id <> vec_id")
    ranked = found.withColumn("rank", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("cosine")))).where(F.col("rank") <= k)
    scanned = asked.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("scanned"))
    return ranked.join(scanned, "query_id").select("query_id", "vec_id", "cosine", "rank", "scanned")


def needed(index: DataFrame, centres: np.ndarray, queries: DataFrame, exact: DataFrame, share: float) -> int:
    """The fewest cells that each query must look into for this share of the exact nearest (query_id, vec_id) to be found."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = vectors._matrix(b["embedding"]) @ centres.T
                own = near[np.arange(len(b)), b["cell"].to_numpy()]
                yield pd.DataFrame({"place": (near >= own[:, None]).sum(axis=1)})

    wanted = exact.select("query_id", "vec_id").join(index.select("vec_id", "cell"), "vec_id").join(queries.select("query_id", "embedding"), "query_id")
    # at most a row for each cell
    counts = sorted((r["place"], r["n"]) for r in wanted.select("cell", "embedding").mapInPandas(places, "place int").groupBy("place").agg(F.count("*").alias("n")).collect())
    total, held = sum(n for _, n in counts), 0
    for place, n in counts:
        held += n
        if held >= share * total:
            return place
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, hits, wanted: how many of each query's exact nearest (query_id, vec_id) are among the found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
