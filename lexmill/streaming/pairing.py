"""Starts and ends of calls from two streams, matched within a bound of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(began: DataFrame, ended: DataFrame, keys: list[str], within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """keys, began_at, ended_at, state of starts (keys, began_at) and ends (keys, ended_at): an end belongs to a start of its keys up to `within` before it.

    A start without an end is running, an end without a start still shown.
    Repeated starts and ends (all columns equal) count once. On streams both
    sides have watermarks, so what is kept is bounded, and a row without a
    match comes out when none can follow any more.
    """
    a, b = began.select(*keys, F.col("began_at").cast("timestamp").alias("began_at")), ended.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ended_at").cast("timestamp").alias("ended_at"))
    if a.isStreaming:
        a, b = a.withWatermark("began_at", late), b.withWatermark("ended_at", late)
        a, b = a.dropDuplicatesWithinWatermark([*keys, "began_at"]), b.dropDuplicatesWithinWatermark([*[f"_{k}" for k in keys], "ended_at"])
    else:
        a, b = a.distinct(), b.distinct()
    same = F.expr(" and ".join(f"{k} = _{k}" for k in keys) + f" and ended_at >= began_at and ended_at <= began_at + interval {within}")
    state = F.when(F.col("ended_at").isNull(), "running").when(F.col("began_at").isNull(), "unknown start").otherwise("done")
    return a.join(b, same, "full_outer").select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], "began_at", "ended_at", state.alias("state"))
