"""Usage, budgets, caches and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def daily(calls: DataFrame) -> DataFrame:
    """day, model, calls, tokens, seconds from (at, model, tokens, seconds): a missing figure counts 0, its call 1.

    The roll-up of roll-ups is the same sum, so batches may be added to an earlier result with add_usage().
    """
    return calls.groupBy(F.to_date("at").alias("day"), "model").agg(F.count("*").alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))


def add_usage(held: DataFrame, more: DataFrame) -> DataFrame:
    return held.unionByName(more).groupBy("day", "model").agg(*[F.sum(c).alias(c) for c in ("calls", "tokens", "seconds")])


def tokens_per_second(usage: DataFrame, today: Column, days: int, excluded: list[str]) -> DataFrame:
    """One row: tokens / seconds of the last `days` days over models that are not excluded; null if either is 0."""
    recent = usage.where((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today) & ~F.col("model").isin(excluded))
    total = recent.agg(F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    return total.select((F.nullif("tokens", F.lit(0)) / F.nullif("seconds", F.lit(0.0))).alias("tokens_per_s"))


def claims(requests: DataFrame, cap: Column) -> DataFrame:
    """Requests (provider, day, at, id) in order of arrival with `used` so far and whether they are granted."""
    order = W.partitionBy("provider", "day").orderBy("at", "id")
    n = F.row_number().over(order)
    return requests.withColumn("granted", n <= cap).withColumn("used", F.least(n, cap))


def fresh(cache: DataFrame, now: Column, ttl: float = 7 * 86400.0) -> DataFrame:
    """Entries that are not expired; an entry exactly ttl old is."""
    return cache.where(now - F.col("stored_at") < ttl)


def latest(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key: keyed overwrite."""
    by = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return entries.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def paired(began: DataFrame, ended: DataFrame, key: list[str]) -> DataFrame:
    """Starts with their ends; an unmatched start is running, an unmatched end still shown."""
    both = began.join(ended, key, "full_outer")
    return both.withColumn("state", F.when(F.col("ended_at").isNull(), "running").when(F.col("began_at").isNull(), "unknown start").otherwise("done"))


def latched(events: DataFrame, by: list[str], order: list[str], sets: Column, resets: Column) -> DataFrame:
    """`confined`: whether the latch was set since the last reset, this event included."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    era = events.withColumn("_era", F.sum(resets.cast("int")).over(w))
    own = W.partitionBy(*by, "_era").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return era.withColumn("confined", F.max(sets.cast("int")).over(own) == 1).drop("_era")


def smoothed_rate(observed: DataFrame, by: str, order: str, value: str, start: float = 4.0, keep: float = 0.7, least: float = 2.0, most: float = 6.0) -> DataFrame:
    """The rate after all observations of a group in order: keep x rate + (1 - keep) x value, clamped each time; null and 0 are skipped."""
    rows = observed.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("seen"))
    step = lambda r, x: F.when(F.coalesce(x[value], F.lit(0.0)) == 0, r).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), keep * r + (1 - keep) * x[value])))
    return rows.select(by, F.aggregate("seen", F.lit(start), step).alias("rate"))


def tree(trace: DataFrame, by: str, order: str, kind: str, levels: list[str]) -> DataFrame:
    """parent: for each event the last event before it of the level above."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parent = F.lit(None).cast("long")
    for upper, lower in zip(levels, levels[1:], strict=False):
        last = F.last(F.when(F.col(kind) == upper, F.col(order)), ignorenulls=True).over(w)
        parent = F.when(F.col(kind) == lower, last).otherwise(parent)
    return trace.withColumn("parent", parent)
