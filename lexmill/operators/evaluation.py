"""Scores of rankings against labelled spans, and agreement of judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, gold_id, rank: each gold span once, at the first passage that covers a line of it.

    ranked: query_id, rank, path, page, start, end. gold: query_id, gold_id,
    path, page, start, end. Pages are equal if both are null. Ends count.
    """
    r, g = ranked.alias("r"), gold.alias("g")
    over = (F.col("r.query_id") == F.col("g.query_id")) & (F.col("r.path") == F.col("g.path")) & F.col("r.page").eqNullSafe(F.col("g.page")) & (F.col("r.start") <= F.col("g.end")) & (F.col("g.start") <= F.col("r.end"))
    return g.join(r, over).groupBy("g.query_id", "gold_id").agg(F.min("r.rank").alias("rank"))


def rank_scores(found: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10), depth: int = 10) -> DataFrame:
    """query_id, golds, recall_at_k for each k, reciprocal_rank, ndcg; queries without gold are left out.

    found is what hits() returns. A rank that covers several new spans gains 1
    in nDCG, and the ideal has min(depth, golds) ranks.
    """
    golds = gold.groupBy("query_id").agg(F.count("*").alias("golds"))
    recalled = [F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks]
    per = found.groupBy("query_id").agg(*recalled, F.min("rank").alias("first"), F.collect_set(F.when(F.col("rank") <= depth, F.col("rank"))).alias("ranks"))
    gain = lambda ranks: F.aggregate(F.sort_array(ranks), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    ideal = gain(F.sequence(F.lit(1), F.least(F.lit(depth), F.col("golds").cast("int"))))
    joined = golds.join(per, "query_id", "left")
    return joined.select(
        "query_id", "golds", *[(F.coalesce(f"n_{k}", F.lit(0)) / F.col("golds")).alias(f"recall_at_{k}") for k in ks],
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.size("ranks") > 0, gain(F.transform("ranks", lambda r: r.cast("int"))) / ideal).otherwise(0.0).alias("ndcg"),
    )


def nearest_rank(value: str, p: float) -> Column:
    """The value of a column at place ceil(p x n) of its sorted values, as an aggregate; nulls do not count."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def known_rate(flag: Column) -> Column:
    """Share of true among the known; null if none is known."""
    return F.avg(flag.cast("double"))


def agreement(rows: DataFrame, *by: str) -> DataFrame:
    """n, agreed, caught, false_alarms and Cohen's kappa of boolean columns human and judge, per group and overall.

    kappa is null where chance alone would agree always. Rows with a null do not count.
    """
    known = rows.where("human is not null and judge is not null")
    h, j = F.col("human"), F.col("judge")
    agg = (F.count("*").alias("n"), F.count_if(h == j).alias("agreed"), F.count_if(h & j).alias("caught"), F.count_if(~h & j).alias("false_alarms"), F.count_if(h).alias("h"), F.count_if(j).alias("j"))
    out = known.groupingSets([[F.col(b) for b in by], []], *[F.col(b) for b in by]).agg(*agg) if by else known.agg(*agg)
    chance = F.col("h") * F.col("j") + (F.col("n") - F.col("h")) * (F.col("n") - F.col("j"))
    kappa = (F.col("n") * F.col("agreed") - chance) / F.nullif(F.col("n") * F.col("n") - chance, F.lit(0))
    return out.select(*by, "n", "agreed", "caught", "false_alarms", kappa.alias("kappa"))


def bootstrap(paired: DataFrame, rounds: int = 2000, seed: int = 1) -> DataFrame:
    """round, delta: the mean of a - b over resamples of the queries (query_id, a, b).

    Every query gets a Poisson(1) weight in each round, drawn from a hash of
    (seed, round, query), so the rounds are independent of partitioning.
    """
    draws = paired.select("query_id", (F.col("a") - F.col("b")).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "round", "query_id"), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    weight, term, total = F.lit(0), 0.36787944117144233, 0.0
    for n in range(1, 9):
        total += term
        weight = F.when(F.col("u") > total, n).otherwise(weight)
        term /= n
    weighed = draws.withColumn("u", u).withColumn("w", weight)
    return weighed.groupBy("round").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("delta"))


def ordered_mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group; ties go to the shorter, then the first."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    order = W.partitionBy(*by).orderBy(F.desc("n"), F.length(value), value)
    return counted.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
