"""Reports over evaluation rows: means and rates per category, thresholds, spreads, error rates, folds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_distance
from .common import settled, small


def _per_group(rows: DataFrame, by: str, aggregates: Iterable[Column]) -> DataFrame:
    """One row for each value of `by` and one, with overall true, for all rows."""
    return rows.groupingSets([[F.col(by)], []], F.col(by)).agg((F.grouping_id() > 0).alias("overall"), *aggregates)


def rank_report(scores: DataFrame, by: str = "category") -> DataFrame:
    """by, overall, n, answerable, means of the measures of evaluation.rank_scores, and top_score.

    scores has a row for each query: `by`, top_score (null if nothing was
    found, which counts 0) and the measures, null where the query has no
    answer; such queries count in n and top_score only.
    """
    measures = [c for c in scores.columns if c.startswith("recall_at_") or c in ("reciprocal_rank", "ndcg")]
    return _per_group(scores, by, [F.count("*").alias("n"), F.count(measures[0]).alias("answerable"), *[F.avg(c).alias(c) for c in measures], F.avg(F.coalesce("top_score", F.lit(0.0))).alias("top_score")])


def outcome(searched: Column, n_gold: Column, n_shown: Column, n_cited: Column, judged: Column) -> Column:
    """What became of an answer: shown and cited are shares of the gold passages, null where there are none; supported is null unless a judge knew."""
    share = lambda n: n / F.nullif(n_gold, F.lit(0))
    return F.struct(searched.alias("searched"), share(n_shown).alias("shown"), share(n_cited).alias("cited"), F.when(judged == "yes", True).when(judged == "no", False).alias("supported"))


def outcome_report(rows: DataFrame, by: str = "category") -> DataFrame:
    """by, overall, n, searched, shown_recall, cited_recall, supported, errors, s_median, s_p95 of rows (searched, shown, cited, supported, error, seconds).

    Rates are over the rows where the flag is known, null if none is; the p95 is the nearest rank's.
    """
    rate = lambda c: F.avg(F.col(c).cast("double"))
    own = [F.count("*").alias("n"), rate("searched").alias("searched"), rate("shown").alias("shown_recall"), rate("cited").alias("cited_recall"), rate("supported").alias("supported")]
    return _per_group(rows, by, [*own, F.count("error").alias("errors"), F.median("seconds").alias("s_median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("s_p95")])


def at_lines(rows: DataFrame, lines: list[float], by: list[str] | None = None) -> DataFrame:
    """line, kept, right, precision, recall for each line: of rows (score, good) those with score >= line are kept; recall is of all good ones.

    Each row is counted for the lines that it reaches, in one pass; a line that nothing reaches has null precision.
    """
    by = by or []
    counts = [F.struct(F.lit(x).alias("line"), F.count_if(F.col("score") >= x).alias("kept"), F.count_if((F.col("score") >= x) & F.col("good")).alias("right")) for x in lines]
    each = rows.groupBy(*by).agg(F.count_if("good").alias("good"), F.array(*counts).alias("at")).select(*by, "good", F.explode("at").alias("a"))
    return each.select(*by, "a.line", "a.kept", "a.right", (F.col("a.right") / F.nullif(F.col("a.kept"), F.lit(0))).alias("precision"), (F.col("a.right") / F.nullif(F.col("good"), F.lit(0))).alias("recall"))


def reaching(rows: DataFrame, lines: list[float], *columns: str) -> DataFrame:
    """line and, for each column, the share of rows whose value reaches it; nulls reach nothing."""
    shares = lambda x: [F.avg((F.coalesce(F.col(c), F.lit(float("-inf"))) >= x).cast("double")).alias(c) for c in columns]
    return rows.agg(F.array(*[F.struct(F.lit(x).alias("line"), *shares(x)) for x in lines]).alias("at")).select(F.explode("at").alias("a")).select("a.*")


def spread(value: str) -> list[Column]:
    """least, median and most, rounded to two places, as aggregates."""
    return [F.round(F.min(value), 2).alias("least"), F.round(F.median(value), 2).alias("median"), F.round(F.max(value), 2).alias("most")]


#: Parts to which a range of values is cut in a round of selection.
_PARTS = 256


def _same(keys: list[str]) -> Column:
    """Whether two sides agree in all keys, nulls included; those of the right side end with an underscore."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys), F.lit(True))


def order_statistics(rows: DataFrame, by: list[str], value: str, places: DataFrame) -> DataFrame:
    """by, place, found: the place-th smallest value of each group (places from 1; null values do not count).

    Exact, and no group is sorted or held by one task: the range in which a
    place lies is cut to parts, values are counted by part, and the part that
    holds the place is the next range, until its values are equal. A round is
    one count over the rows still in range; 256 parts shrink a range so fast
    that a few rounds do.
    """
    own = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in by], F.col(value).cast("double").alias("_v"))
    keys = [f"_{c}" for c in by]
    ranges = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    named = places.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("place").alias("_place"))
    open_ = settled(named.join(ranges.withColumnsRenamed({k: f"{k}_" for k in keys}), _same(keys)).where("_place between 1 and _n").select(*keys, "_place", F.col("_place").alias("_left"), "_lo", "_hi"))
    done = open_.where("_lo = _hi")
    open_ = open_.where("_lo < _hi")
    while open_.take(1):
        asked = small(open_.withColumnsRenamed({k: f"{k}_" for k in keys}))
        part = F.least(F.lit(_PARTS - 1), F.floor((F.col("_v") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / _PARTS))).cast("int")
        within = own.join(asked, _same(keys)).where("_v between _lo and _hi")
        counted = within.groupBy(*keys, "_place", "_left", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # at most _PARTS rows for each place
        parts = counted.groupBy(*keys, "_place", "_left").agg(F.sort_array(F.collect_list(F.struct("_part", "_n", "_lo", "_hi"))).alias("_parts"))
        empty = F.struct(F.col("_left").cast("long").alias("left"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

        def step(s: Column, x: Column) -> Column:
            here = s["lo"].isNull() & (s["left"] <= x["_n"])
            return F.when(s["lo"].isNotNull(), s).when(here, F.struct(s["left"].alias("left"), x["_lo"].alias("lo"), x["_hi"].alias("hi"))).otherwise(F.struct((s["left"] - x["_n"]).alias("left"), s["lo"].alias("lo"), s["hi"].alias("hi")))

        now = settled(parts.select(*keys, "_place", F.aggregate("_parts", empty, step).alias("s")).select(*keys, "_place", F.col("s.left").alias("_left"), F.col("s.lo").alias("_lo"), F.col("s.hi").alias("_hi")))
        done, open_ = done.unionByName(now.where("_lo = _hi")), now.where("_lo < _hi")
    return done.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.col("_place").alias("place"), F.col("_lo").alias("found"))


def exclusive_quantile(rows: DataFrame, by: list[str], value: str, part: int, parts: int) -> DataFrame:
    """by, n, quantile: the cut point part / parts of values taken as a sample of more (places count from 1 of n + 1); null for fewer than two.

    The two values about the cut are selected, not sorted.
    """
    sizes = settled(rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")))
    low = F.greatest(F.lit(1), F.least(F.floor(part * (F.col("n") + 1) / parts), F.col("n") - 1)).cast("long")
    cut = sizes.withColumn("low", low).withColumn("delta", part * (F.col("n") + 1) - low * parts)
    found = order_statistics(rows, by, value, cut.where("n > 1").select(*by, F.explode(F.array("low", F.col("low") + 1)).alias("place")))
    both = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "found"))).alias("_about"))
    joined = cut.join(both.withColumnsRenamed({c: f"{c}_" for c in by}), _same(by), "left")
    weighed = (F.col("_about")[0]["found"] * (parts - F.col("delta")) + F.col("_about")[1]["found"] * F.col("delta")) / parts
    return joined.select(*by, "n", F.when(F.col("n") > 1, weighed).alias("quantile"))


def error_rates(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, edits, expected_tokens, error_rate, exact of token arrays (expected, said): edits over expected tokens, and the share of pairs that are equal."""
    edits = pairs.withColumn("edits", token_distance(F.col("expected"), F.col("said")))
    aggregates = [F.count("*").alias("n"), F.sum("edits").alias("edits"), F.sum(F.size("expected")).alias("expected_tokens"), F.avg((F.col("edits") == 0).cast("double")).alias("exact")]
    out = edits.groupBy(*(by or [])).agg(*aggregates)
    return out.withColumn("error_rate", F.col("edits") / F.nullif(F.col("expected_tokens"), F.lit(0)))


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted mean, held between the least and the largest value that has weight; as an aggregate."""
    has = F.when(F.col(weight) > 0, F.col(value))
    mean = F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0.0))
    return F.least(F.greatest(mean, F.min(has)), F.max(has))


def fold_of(key: str, secret: str = "fold") -> Column:
    """0 or 1 (a tenth each), else 2: by a keyed digest, so a key's fold never changes."""

    def fold(word: str) -> int:
        number = int.from_bytes(hashlib.blake2b(word.encode(), key=secret.encode(), digest_size=8).digest(), "big")
        return min(number % 10, 2)

    @F.pandas_udf("int")
    def folds(words: pd.Series) -> pd.Series:
        return words.map(fold, na_action="ignore").astype("Int32")

    return folds(F.col(key))


def passages_key(question: str, answer: str, passages: str) -> list[Column]:
    """What names a verdict: question, answer and a digest of the canonical JSON of the passages (an array of strings)."""
    return [F.col(question), F.col(answer), F.sha2(F.to_json(passages), 256).alias("passages_sha256")]


def ngram_probabilities(sequences: DataFrame, order: int = 2) -> DataFrame:
    """history (array), token, n, probability by Witten-Bell: (c + T p') / (N + T), p' being that of the history without its first token.

    sequences: tokens (array). Of a history N is the number of tokens that follow
    it, T of the distinct ones; below the shortest, p' is even over the vocabulary.
    Each order is one count and one join with the order below.
    """
    def follows(k: int) -> Column:
        places = F.when(F.size("tokens") > k, F.sequence(F.lit(k + 1), F.size("tokens"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.slice("tokens", i - k, F.lit(k)).alias("history"), F.element_at("tokens", i).alias("token")))

    each = sequences.select(F.explode(F.concat(*[follows(k) for k in range(order)])).alias("g")).select("g.*")
    counted = each.groupBy("history", "token").agg(F.count("*").alias("n"))
    totals = counted.groupBy("history").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    whole = counted.join(totals, "history")
    size = counted.where(F.size("history") == 0).agg(F.count("*").alias("vocabulary"))  # one row
    out = whole.where(F.size("history") == 0).join(F.broadcast(size)).select("history", "token", "n", ((F.col("n") + F.col("kinds") / F.col("vocabulary")) / (F.col("all") + F.col("kinds"))).alias("probability"))
    below = out
    for k in range(1, order):
        shorter = below.select(F.col("history").alias("_short"), "token", F.col("probability").alias("_p"))
        now = whole.where(F.size("history") == k).withColumn("_short", F.slice("history", 2, k - 1) if k > 1 else F.array().cast("array<string>"))
        below = now.join(shorter, ["_short", "token"]).select("history", "token", "n", ((F.col("n") + F.col("kinds") * F.col("_p")) / (F.col("all") + F.col("kinds"))).alias("probability"))
        out = out.unionByName(below)
    return out

