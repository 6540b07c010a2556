"""Usage, traces, budgets, memory and judgements over events, conversations and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import evaluation, memory, usage
from ..streaming import idle, pairing, stateful, windows
from .registry import query, table

DAY = "DATE '2024-01-15'"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as model calls: the type is the model, k the tokens, the value the seconds."""
    return table(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("seconds"))


USAGE = "usage AS (SELECT CAST(ts AS DATE) AS day, event_type AS model, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, sum(value) AS seconds FROM events GROUP BY ALL)"


@query(f"WITH {USAGE} SELECT day, model, calls, tokens, round(seconds, 4) AS seconds FROM usage")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily(_calls(spark, d)).withColumn("seconds", F.round("seconds", 4))


@query(f"WITH {USAGE} SELECT model, calls, tokens, row_number() OVER (ORDER BY calls DESC, model) AS place FROM usage WHERE day = {DAY}")
def usage_today(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    # a row for each model, so one window over all of them is small
    today = usage.daily(_calls(spark, d).where(F.to_date("at") == F.expr(DAY)))
    return today.withColumn("place", F.row_number().over(W.orderBy(F.desc("calls"), "model"))).select("model", "calls", "tokens", "place")


@query(f"WITH {USAGE} SELECT round(nullif(sum(tokens), 0) / nullif(sum(seconds), 0), 6) AS tokens_per_s FROM usage WHERE day > {DAY} - 7 AND day <= {DAY} AND model NOT IN ('error')")
def tokens_per_second(spark: SparkSession, d: str) -> DataFrame:
    return usage.tokens_per_second(usage.daily(_calls(spark, d)), F.expr(DAY), 7, ["error"]).select(F.round("tokens_per_s", 6).alias("tokens_per_s"))


@query("""SELECT event_type AS provider, CAST(ts AS DATE) AS day, CAST(count(*) FILTER (n <= 40) AS BIGINT) AS granted, CAST(count(*) FILTER (n > 40) AS BIGINT) AS refused
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) GROUP BY ALL""")
def budget_claims(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.to_date("ts").alias("day"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return usage.claims(asked, F.lit(40)).groupBy("provider", "day").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))


@query("SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, median(value) AS median, max(value) AS most FROM events GROUP BY ALL")
def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(evaluation.nearest_rank("value", 0.95).alias("p95"), F.median("value").alias("median"), F.max("value").alias("most"))


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS stored FROM events WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) < 604800 GROUP BY ALL""")
def cache_fresh(spark: SparkSession, d: str) -> DataFrame:
    """The latest entry of each key that is under seven days old."""
    stored = table(spark, d, "events").select("user_id", "event_id", "ts", F.col("ts").cast("timestamp").cast("double").alias("stored_at"))
    live = usage.fresh(stored, F.lit("2024-01-31").cast("timestamp").cast("double"))
    return usage.latest(live, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.floor("stored_at").cast("long").alias("stored"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, ts, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM events)
SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, era ORDER BY ts, event_id) = 1 AS confined FROM o""")
def confinement(spark: SparkSession, d: str) -> DataFrame:
    """An error confines a user until the next signup."""
    e = table(spark, d, "events")
    return usage.latched(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup").select("event_id", "confined")


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value <> 0),
r AS (SELECT user_id, 0::BIGINT AS n, 4.0::DOUBLE AS rate FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT r.user_id, r.n + 1, least(6.0, greatest(2.0, 0.7 * r.rate + 0.3 * (o.value / 10))) FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, round(arg_max(rate, n), 6) AS rate FROM r GROUP BY ALL""")
def smoothed_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("value") / 10).alias("seen"))
    return usage.smoothed_rate(e, "user_id", "at", "seen").select("user_id", F.round("rate", 6).alias("rate"))


@query("""SELECT coalesce(v.user_id, p.user_id) AS user_id, CASE WHEN p.n IS NULL THEN 'running' WHEN v.n IS NULL THEN 'unknown start' ELSE 'done' END AS state
FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY ALL) v FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY ALL) p ON v.user_id = p.user_id""")
def paired_calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value > 60")
    began = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("began_at"))
    ended = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ended_at"))
    return usage.paired(began, ended, ["user_id"]).select("user_id", "state")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w WHEN 'click' THEN max(CASE WHEN event_type = 'view' THEN event_id END) OVER w END AS parent
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def trace_tree(spark: SparkSession, d: str) -> DataFrame:
    """Signups hold views, views hold clicks, by order of arrival."""
    return usage.tree(table(spark, d, "events"), "user_id", "event_id", "event_type", ["signup", "view", "click"]).select("event_id", "parent")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.counted(table(spark, d, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) AS r(k) GROUP BY ALL""")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return windows.counted(table(spark, d, "events"), "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""")
def sessions_gap(spark: SparkSession, d: str) -> DataFrame:
    s = windows.sessions(table(spark, d, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("event_type").alias("kind"))


EVENTS_OF = """o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch(ts) AS at, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


@query(f"""WITH RECURSIVE {EVENTS_OF}, r AS (SELECT key, event_id, n, NULL::DOUBLE AS older, o.at AS newer, 'granted' AS outcome FROM o WHERE n = 1
  UNION ALL SELECT o.key, o.event_id, o.n, CASE WHEN r.older + 21600 > o.at THEN r.older ELSE r.newer END, CASE WHEN r.older + 21600 > o.at THEN r.newer ELSE o.at END, CASE WHEN r.older + 21600 > o.at THEN 'refused' ELSE 'granted' END
  FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1) SELECT key, event_id, outcome FROM r""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """At most two events of a user in any six hours."""
    return stateful.folded(_keyed(spark, d), stateful.rate_limit(2, 6 * 3600.0)).select("key", "event_id", "outcome")


@query(f"""WITH RECURSIVE {EVENTS_OF}, r AS (SELECT key, event_id, n, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS failed, NULL::DOUBLE AS opened, 'closed' AS outcome FROM o WHERE n = 1
  UNION ALL SELECT o.key, o.event_id, o.n, CASE WHEN kind = 'error' THEN failed + 1 WHEN opened IS NULL OR o.at - opened >= 86400 THEN 0 ELSE failed END,
    CASE WHEN kind = 'error' THEN CASE WHEN opened IS NOT NULL OR failed + 1 >= 2 THEN o.at END WHEN o.at - opened >= 86400 THEN NULL ELSE opened END,
    CASE WHEN o.at - opened >= 86400 THEN 'half-open' WHEN opened IS NULL THEN 'closed' ELSE 'open' END
  FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1) SELECT key, event_id, outcome FROM r""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return stateful.folded(_keyed(spark, d), stateful.circuit(2, 86400.0)).select("key", "event_id", "outcome")


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')
SELECT key, event_id, CASE WHEN n > 3 THEN 'escalated' ELSE (['0.5', '1', '2'])[n] END AS outcome FROM c""")
def restart_intensity(spark: SparkSession, d: str) -> DataFrame:
    return stateful.folded(_keyed(spark, d).where("kind = 'error'"), stateful.restarts(3, 2 * 86400.0)).select("key", "event_id", "outcome")


@query("SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return memory.exchanges(table(spark, d, "conversations"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY ALL")
def last_turn(spark: SparkSession, d: str) -> DataFrame:
    return memory.last_turn(table(spark, d, "conversations"))


@query("SELECT conv_id, turn, kept_tokens FROM (SELECT conv_id, turn, CAST(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS kept_tokens FROM conversations) WHERE kept_tokens <= 384")
def context_overflow(spark: SparkSession, d: str) -> DataFrame:
    """The latest turns that fit three quarters of a window of 512 tokens, at four characters a token."""
    return memory.within_window(table(spark, d, "conversations"), F.ceil(F.length("text") / 4.0), 384).select("conv_id", "turn", "kept_tokens")


@query("SELECT owner, position, used FROM (SELECT conv_id AS owner, turn AS position, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM conversations WHERE role = 'user') WHERE used <= 600")
def pinned_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("owner"), F.col("turn").alias("position"), "text")
    return memory.pinned(facts, F.length("text"), 600).select("owner", "position", "used")


FACTS = "facts AS (SELECT user_id AS owner, event_type AS subject, event_id AS fact_id, ts AS since, lead(ts) OVER w AS until, lead(event_id) OVER w AS replaced_by FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    stated = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("subject"), F.col("event_id").alias("fact_id"), F.col("ts").alias("at"), F.col("props").alias("text"))
    return memory.versions(stated)


@query(f"WITH {FACTS} SELECT * FROM facts")
def fact_versions(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).drop("text")


@query(f"WITH {FACTS} SELECT owner, subject, fact_id FROM facts WHERE until IS NULL")
def facts_current(spark: SparkSession, d: str) -> DataFrame:
    return memory.current(_versions(spark, d)).select("owner", "subject", "fact_id")


@query(f"WITH {FACTS} SELECT owner, subject, fact_id FROM facts WHERE since <= TIMESTAMP '2024-01-15 12:00:00' AND (until IS NULL OR TIMESTAMP '2024-01-15 12:00:00' < until)")
def facts_as_of(spark: SparkSession, d: str) -> DataFrame:
    return memory.as_of(_versions(spark, d), F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")).select("owner", "subject", "fact_id")


@query()
def fact_learning(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as facts of the owner that their label names, told in order of their ids."""
    told = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("owner"), F.col("vec_id").alias("fact_id"), F.lit(-1).cast("long").alias("replaces"), "embedding")
    return memory.learn(told)


@query("""WITH c AS (SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(kind), kind) AS r FROM c) WHERE r = 1""")
def majority(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"))
    return evaluation.ordered_mode(e, ["user_id"], "kind")


JUDGED = "judged AS (SELECT d.lang, l.quality = 1 AS human, length(d.text) >= 200 AS judge FROM labels l JOIN documents d USING (doc_id))"
COUNTS = "n, agreed, caught, false_alarms, round((n * agreed - (h * j + (n - h) * (n - j))) / nullif(n * n - (h * j + (n - h) * (n - j)), 0), 6) AS kappa"
AGREE = "count(*) AS n, count(*) FILTER (human = judge) AS agreed, count(*) FILTER (human AND judge) AS caught, count(*) FILTER (NOT human AND judge) AS false_alarms, count(*) FILTER (human) AS h, count(*) FILTER (judge) AS j"


@query(f"WITH {JUDGED} SELECT lang, {COUNTS} FROM (SELECT lang, {AGREE} FROM judged GROUP BY GROUPING SETS ((lang), ()))")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Quality labels against a judge that asks for 200 characters; overall (null) and per language."""
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id").select("lang", (F.col("quality") == 1).alias("human"), (F.length("text") >= 200).alias("judge"))
    return evaluation.agreement(both, "lang").withColumn("kappa", F.round("kappa", 6))


@query("SELECT source, count(*) AS n, round(avg(CASE WHEN toxic IS NOT NULL THEN CAST(toxic AS DOUBLE) END), 6) AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def known_rates(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.round(evaluation.known_rate(F.col("toxic")), 6).alias("toxic_rate"))


@query("""WITH e AS (SELECT DISTINCT user_id, date_trunc('milliseconds', ts) AS ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM e)
SELECT user_id, ts AS since, ts + INTERVAL 1 DAY AS due FROM n WHERE next IS NULL OR next > ts + INTERVAL 1 DAY""")
def idle_gaps(spark: SparkSession, d: str) -> DataFrame:
    """When users were quiet for a day; on a stream the same is told by timers."""
    return idle.idle_gaps(table(spark, d, "events"), 86_400)


@query("""WITH a AS (SELECT DISTINCT user_id, ts AS began_at FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id, ts AS ended_at FROM events WHERE event_type = 'purchase'),
m AS (SELECT a.user_id, began_at, ended_at FROM a JOIN b ON a.user_id = b.user_id AND ended_at >= began_at AND ended_at <= began_at + INTERVAL 12 HOUR)
SELECT user_id, began_at, ended_at, 'done' AS state FROM m UNION ALL SELECT user_id, began_at, NULL, 'running' FROM a ANTI JOIN m USING (user_id, began_at) UNION ALL SELECT user_id, NULL, ended_at, 'unknown start' FROM b ANTI JOIN m USING (user_id, ended_at)""")
def paired_within(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups with purchases up to twelve hours later, and both that have none."""
    e = table(spark, d, "events")
    side = lambda kind, at: e.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(at))
    return pairing.paired(side("signup", "began_at"), side("purchase", "ended_at"), ["user_id"], "12 hours")


def _shows(pattern: str, text: str = "text") -> str:
    """SQL that tells whether a fixed pattern is met; DuckDB's patterns can't look ahead, so the one word that a pattern excludes goes from the text."""
    return f"""CAST(regexp_matches({text}, '(?im){pattern.replace("(?!" + _SKIPPED + ")", "").replace("'", "''")}') AS INT)"""


_SKIPPED = r"\s+minister"
_MATHS = _shows(fixed.MATHS, rf"regexp_replace(text, '(?i)prime{_SKIPPED}', '', 'g')")
_POINTS = " + ".join(f"{points} * {_MATHS if pattern == fixed.MATHS else _shows(pattern)}" for pattern, points in fixed.POINTS.items())


@query(rf"""WITH t AS (SELECT conv_id, turn, text, {_MATHS} = 1 AS maths, len(regexp_extract_all(text, '\S+')) AS words, length(text) - length(replace(text, '?', '')) AS asked FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, words, {_POINTS} + CAST(NOT maths AND regexp_matches(text, '{fixed.ARITHMETIC}') AS INT)
  + CAST(asked >= 2 OR (asked = 1 AND len(regexp_extract_all(text, '{fixed.LIST_ITEM}')) >= 2) AS INT) + CAST(words > 80 AS INT) AS p FROM t)
SELECT conv_id, turn, CASE WHEN p >= 3 THEN 'high' WHEN p >= 2 THEN 'medium' WHEN p = 0 AND words <= 8 THEN 'off' ELSE 'low' END AS level,
  CAST(CASE WHEN p >= 3 THEN 1500 WHEN p >= 2 THEN 500 WHEN p = 0 AND words <= 8 THEN NULL ELSE 125 END AS BIGINT) AS token_limit FROM p""")
def reasoning_level(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.reasoning_level(F.col("text")).alias("level"))
    return asked.withColumn("token_limit", T.token_limit(F.col("level"), F.lit(None).cast("double")))


@query("SELECT conv_id, string_agg(concat_ws(':', turn, role, length(text)), ',' ORDER BY turn) AS turns FROM conversations GROUP BY ALL")
def nested_turns(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["turn"], t["role"], t["n"])), ",").alias("turns"))
