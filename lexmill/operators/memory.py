"""Turns and facts of conversations: nesting, budgets, versions, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import vectors
from .common import settled


def exchanges(messages: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user message with the next message, if that is the assistant's."""
    order = W.partitionBy("conv_id").orderBy("turn")
    nexts = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order))
    return nexts.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def last_turn(messages: DataFrame) -> DataFrame:
    """The last message of each conversation."""
    return messages.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"))


def pinned(facts: DataFrame, size: Column, most: int) -> DataFrame:
    """Facts of each owner in order, until the first that would overflow `most` characters; each costs one more for its line end."""
    order = W.partitionBy("owner").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return facts.withColumn("used", F.sum(size + 1).over(order)).where(F.col("used") <= most)


def within_window(messages: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """The latest messages of each conversation whose tokens fit the budget together; older ones are dropped."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    return messages.withColumn("kept_tokens", F.sum(tokens).over(order)).where(F.col("kept_tokens") <= budget)


def versions(facts: DataFrame) -> DataFrame:
    """owner, subject, text, since, until, replaced_by from statements (owner, subject, fact_id, at, text): each holds until the next."""
    order = W.partitionBy("owner", "subject").orderBy("at", "fact_id")
    return facts.select("owner", "subject", "fact_id", "text", F.col("at").alias("since"), F.lead("at").over(order).alias("until"), F.lead("fact_id").over(order).alias("replaced_by"))


def current(facts: DataFrame, held_only: bool = True) -> DataFrame:
    return facts.where("until is null") if held_only else facts


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that held at a time; ranges are half-open."""
    return facts.where((F.col("since") <= at) & (F.col("until").isNull() | (at < F.col("until"))))


def newest_first(facts: DataFrame) -> DataFrame:
    """facts with their place in their owner's order: since descending, then fact_id descending."""
    return facts.withColumn("place", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("since"), F.desc("fact_id"))))


def with_calls(turns: DataFrame, calls: DataFrame, key: str, position: str) -> DataFrame:
    """Each turn with `calls`, an array of its calls by position; empty where it made none."""
    rest = [c for c in calls.columns if c not in (key, position)]
    nested = calls.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(position, *rest))).alias("calls"))
    empty = F.array().cast(nested.schema["calls"].dataType)
    return turns.join(nested, key, "left").withColumn("calls", F.coalesce("calls", empty))


def day_range(since: str, until: str, zone: str) -> tuple[Column, Column]:
    """The time range of whole local days, `until` included: from the start of the first to the start of the day after the last."""
    return F.to_utc_timestamp(F.to_date(F.lit(since)).cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(F.to_date(F.lit(until)), 1).cast("timestamp"), zone)


def cascade(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """The child rows whose parent is still there."""
    return child.join(parent.select(key), key, "left_semi")


def learn(facts: DataFrame, line: float = 0.90, nearest: int = 2) -> DataFrame:
    """Which facts (owner, fact_id, replaces, embedding) are new, told in order of fact_id within an owner: owner, fact_id, kept, like, cosine.

    A fact is passed over if one of its `nearest` held facts (ties included,
    the one it replaces left out) has a cosine of `line` or more; `like` names
    the first such. A kept fact ends the one it replaces.

    No owner is one group: near pairs come from blocks of an owner's vectors,
    and then facts are decided in rounds over that sparse table. A fact is
    passed over once an older near one is known to be held, and kept once all
    older near ones are known not to be; so there are as many rounds as the
    longest chain of facts that hang on each other.
    """
    own = settled(facts.select("owner", "fact_id", "replaces"))
    near = settled(vectors.near_pairs(facts, "owner", "fact_id", line).join(own.select("owner", F.col("fact_id").alias("newer"), "replaces"), ["owner", "newer"]).where(~F.col("older").eqNullSafe(F.col("replaces"))).drop("replaces"))
    ends = own.where("replaces is not null").select("owner", F.col("replaces").alias("older"), F.col("fact_id").alias("ender"))
    # what a newer fact waits for: each older near one and, where it has one before, its ender
    waits = settled(near.select("owner", "newer", "older").join(ends, ["owner", "older"], "left").select("owner", "newer", "older", F.when(F.col("ender") < F.col("newer"), F.col("ender")).alias("ender")))
    decided = settled(own.select("owner", "fact_id").join(waits.select("owner", F.col("newer").alias("fact_id")), ["owner", "fact_id"], "left_anti").withColumn("kept", F.lit(True)))
    while True:
        known = decided.select("owner", F.col("fact_id").alias("_id"), F.col("kept").alias("_kept"))
        open_ = waits.join(decided.select("owner", F.col("fact_id").alias("newer")), ["owner", "newer"], "left_anti")
        seen = open_.join(known.withColumnsRenamed({"_id": "older", "_kept": "older_kept"}), ["owner", "older"], "left").join(known.withColumnsRenamed({"_id": "ender", "_kept": "ender_kept"}), ["owner", "ender"], "left")
        ended = F.when(F.col("ender").isNull(), False).otherwise(F.col("ender_kept"))
        each = seen.groupBy("owner", "newer", "older").agg(F.first("older_kept").alias("held"), F.bool_or(ended).alias("ended"), F.bool_or(F.col("ender").isNotNull() & F.col("ender_kept").isNull()).alias("pending"))
        holds = F.when(F.col("held").isNull(), None).when(~F.col("held"), False).when(F.col("ended"), False).when(F.col("pending"), None).otherwise(True)
        verdict = each.groupBy("owner", F.col("newer").alias("fact_id")).agg(F.bool_or(holds).alias("repeated"), F.bool_or(holds.isNull()).alias("unsure"))
        new = settled(verdict.where("repeated or not unsure").select("owner", "fact_id", (~F.coalesce("repeated", F.lit(False))).alias("kept")))
        if not new.limit(1).count():
            break
        decided = settled(decided.unionByName(new))
    kept = decided.where("kept").select("owner", "fact_id")
    over = waits.join(kept.select("owner", F.col("fact_id").alias("ender")), ["owner", "ender"]).select("owner", "newer", "older").distinct()
    held = near.join(kept.select("owner", F.col("fact_id").alias("older")), ["owner", "older"]).join(over, ["owner", "newer", "older"], "left_anti")
    ranked = held.withColumn("r", F.rank().over(W.partitionBy("owner", "newer").orderBy(F.desc("cosine")))).where(F.col("r") <= max(nearest, 1))
    likes = ranked.groupBy("owner", F.col("newer").alias("fact_id")).agg(F.min(F.struct(F.col("older").alias("like"), "cosine")).alias("first"))
    told = decided.join(likes, ["owner", "fact_id"], "left")
    passed = lambda c: F.when(~F.col("kept"), F.col("first")[c]).alias(c)
    return told.select("owner", "fact_id", "kept", passed("like"), passed("cosine"))


def merge_repeats(pairs: DataFrame, apart: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """owner, older, newer, cosine: pairs (owner, one, other, cosine, same) merged greedily, closest first, each fact once in a pass.

    The older of a pair has the earlier time in `since` (fact, since), then the
    smaller id; by ids alone where no times are given. Pairs in `apart` (one, other) were judged different before and are skipped.
    A pair that comes first for both of its facts is merged whatever the others
    do, so all such pairs merge in one round, which gives the greedy result.
    """
    left = pairs.where("same").join(apart.select("one", "other"), ["one", "other"], "left_anti")
    left = settled(left.select("owner", "one", "other", "cosine", F.struct((-F.col("cosine")).alias("far"), "one", "other").alias("turn")))
    done = None
    while left.limit(1).count():
        ends = left.select("owner", F.explode(F.array("one", "other")).alias("fact"), "turn").groupBy("owner", "fact").agg(F.min("turn").alias("turn"))
        firsts = ends.groupBy("owner", "turn").agg(F.count("*").alias("n")).where((F.col("n") == 2) | (F.col("turn.one") == F.col("turn.other"))).select("owner", "turn")
        chosen = settled(left.join(firsts, ["owner", "turn"]).select("owner", F.least("one", "other").alias("older"), F.greatest("one", "other").alias("newer"), "cosine"))
        done = chosen if done is None else settled(done.unionByName(chosen))
        used = chosen.select("owner", F.explode(F.array("older", "newer")).alias("fact")).distinct()
        for end in ("one", "other"):
            left = left.join(used.withColumnRenamed("fact", end), ["owner", end], "left_anti")
        left = settled(left.select("owner", "one", "other", "cosine", "turn"))
    merged = left.select("owner", F.col("one").alias("older"), F.col("other").alias("newer"), "cosine") if done is None else done
    if since is None:
        return merged
    for end in ("older", "newer"):
        merged = merged.join(since.select(F.col("fact").alias(end), F.struct("since", "fact").alias(f"_{end}")), end, "left")
    swap = F.coalesce(F.col("_newer") < F.col("_older"), F.lit(False))
    return merged.select("owner", F.when(swap, F.col("newer")).otherwise(F.col("older")).alias("older"), F.when(swap, F.col("older")).otherwise(F.col("newer")).alias("newer"), "cosine")


def to_learn(queue: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """Queue rows (item) that have failed fewer than `most` times, with their failures."""
    failed = attempts.groupBy("item").agg(F.count("*").alias("failures"))
    return queue.join(failed, "item", "left").withColumn("failures", F.coalesce("failures", F.lit(0))).where(F.col("failures") < most)

