"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch


def _mins(both: DataFrame) -> DataFrame:
    """Each node with the smallest node among itself and its neighbours.

    Sums are made per task first, and the result is a written table, so that
    adaptive execution can split the links of a hot node where they meet it.
    """
    return saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _mins(down)
    return down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that has a link; root is the smallest node reachable.

    `edges` has columns u and v of one orderable type. Self links, repeated
    links and nulls are ignored; no links give no rows. Each round writes its
    links to the shared folder and compares a digest of them with the last.
    """
    with scratch(edges.sparkSession):
        now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        last = None
        while (digest := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != last and digest[0]:
            last = digest
            now = saved(_small(_large(now)).where("u <> v").distinct())
        both = now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root")))
        return saved(both.groupBy("u").agg(F.min("root").alias("root")), outlives=True)
