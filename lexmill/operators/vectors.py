"""Exact vector search in blocks.

Queries are a stated set. Up to a block of them goes to every task as one
matrix; more are dealt to blocks, and each block meets each part of the vectors
in a group of its own. A task multiplies tiles of bounded size and passes on
what may still be among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Queries in a block; vectors of a part; rows that are multiplied at a time; vectors of one owner in a block.
BLOCK, PART, TILE, OWN_BLOCK = 4096, 50_000, 2048, 2048
DIGITS = 6


def _matrix(embeddings: pd.Series) -> np.ndarray:
    return np.stack(embeddings.to_numpy()).astype(float)


def _tiles(rows: pd.DataFrame, names: np.ndarray, q: np.ndarray, k: int | None, at_least: float) -> Iterator[pd.DataFrame]:
    """query_id, vec_id, cosine of what may be found among some vectors (vec_id, embedding), for queries `names` with matrix `q`."""
    for i in range(0, len(rows), TILE):
        part = rows.iloc[i : i + TILE]
        cosine = np.round(_matrix(part["embedding"]) @ q.T, DIGITS)
        keep = cosine >= at_least
        if k is not None and len(part) > k:  # ties at the k-th stay
            keep &= cosine >= np.partition(cosine, len(part) - k, axis=0)[len(part) - k]
        row, col = np.nonzero(keep)
        yield pd.DataFrame({"query_id": names[col], "vec_id": part["vec_id"].to_numpy()[row], "cosine": cosine[row, col]})


_FOUND = "query_id long, vec_id long, cosine double"


def _scored(vectors: DataFrame, queries: DataFrame, k: int | None, at_least: float, block: int = BLOCK) -> DataFrame:
    held = vectors.where("embedding is not null").select("vec_id", "embedding")
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    n = asked.count()
    if n <= block:
        rows = sorted(asked.collect(), key=lambda r: r["query_id"])
        names, q = np.array([r["query_id"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(names):
                    yield from _tiles(b, names, q, k, at_least)

        return held.mapInPandas(run, _FOUND)

    def meet(own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if own.empty or q.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        q = q.sort_values("query_id")
        return pd.concat(list(_tiles(own, q["query_id"].to_numpy(), _matrix(q["embedding"]), k, at_least)))

    blocks, parts = -(-n // block), max(1, -(-held.count() // PART))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    own = held.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    theirs = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    return own.groupBy("block", "part").cogroup(theirs.groupBy("block", "part")).applyInPandas(meet, _FOUND)


def near_pairs(rows: DataFrame, owner: str, key: str, at_least: float, block: int = OWN_BLOCK) -> DataFrame:
    """owner, newer, older, cosine: pairs of one owner's vectors (embedding) with a cosine of at_least or more; newer has the larger key.

    An owner's vectors are dealt to blocks, and each pair of blocks is a group,
    so no group has more than about two blocks however many an owner has.
    """
    held = rows.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(owner, key, "embedding")
    sizes = held.groupBy(owner).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = held.join(sizes.withColumnRenamed(owner, "_o"), F.col(owner).eqNullSafe(F.col("_o"))).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    met = dealt.withColumn("_x", other).select(owner, key, "embedding", "_b", F.least("_b", "_x").alias("_low"), F.greatest("_b", "_x").alias("_high"))

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["_b"] == group["_low"].iloc[0]], group[group["_b"] == group["_high"].iloc[0]]
        out = []
        if len(a) and len(b):
            right, names = _matrix(b["embedding"]), b[key].to_numpy()
            for i in range(0, len(a), TILE):
                part = a.iloc[i : i + TILE]
                cosine = np.round(_matrix(part["embedding"]) @ right.T, DIGITS)
                row, col = np.nonzero(cosine >= at_least)
                out.append(pd.DataFrame({"x": part[key].to_numpy()[row], "y": names[col], "cosine": cosine[row, col]}))
        found = pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "cosine": []})
        found = found[found["x"] != found["y"]]
        return pd.DataFrame({owner: [group[owner].iloc[0]] * len(found), "newer": np.maximum(found["x"], found["y"]).astype(np.int64), "older": np.minimum(found["x"], found["y"]).astype(np.int64), "cosine": found["cosine"].astype(float)}).drop_duplicates(["newer", "older"])

    return met.groupBy(owner, "_low", "_high").applyInPandas(pairs, f"{owner} long, newer long, older long, cosine double").dropDuplicates([owner, "newer", "older"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, others_only: bool = False) -> DataFrame:
    """query_id, vec_id, cosine, rank of the k nearest; all ties at the cut are kept."""
    found = _scored(vectors, queries, k + others_only, -2.0)
    if others_only:
        found = found.where("query_id <> vec_id")
    order = W.partitionBy("query_id").orderBy(F.desc("cosine"))
    return found.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= k)


def close_pairs(vectors: DataFrame, queries: DataFrame, at_least: float) -> DataFrame:
    """query_id, vec_id, cosine of all vectors with a cosine of at_least or more to a query, the query itself left out."""
    return _scored(vectors, queries, None, at_least).where("query_id <> vec_id")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
