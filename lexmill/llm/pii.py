"""Personal data by rules and by bootstrapped contextual extraction, in DataFrame functions only.

Base rules find emails, IP addresses, cards and phones. They are the seeds of
the method: the words around a seed are a lexical pattern of its kind, the
identifier-like tokens that a pattern meets are its instances, and the graph of
patterns and instances is scored in turns. A pattern's confidence in a kind is
the share of its distinct instances that are of it, instances counting by their
own score; an instance's score is the chance that one of its patterns is right.
Patterns that stay confident and have support from several instances mark the
identifiers that the rules miss.

A fifth kind, secret, has no base rule: its seeds are hexadecimal strings of 32
digits or more, as keys and digests are written. Seeds are no finds: what the
method adds are tokens that only a pattern marks, of this kind or another.

Places in a text are code points; an end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch, table

KINDS = ("email", "ip", "card", "phone")
#: The kinds and, after them, the one that only the method finds.
NAMES = (*KINDS, "secret")
_SECRET, _IS_SECRET = len(KINDS), "^[0-9A-Fa-f]{32,}$"
#: Turns of scoring; least confidence and least support of a pattern that marks identifiers.
ROUNDS, LEAST_CONFIDENCE, LEAST_SUPPORT = 4, 0.8, 5
#: In recovered() one seed of so many is hidden.
HIDDEN = 10
#: Numbers that are summed in one step when places are counted.
_STEP = 128

# The contract's patterns with possessive repeats where backtracking can't help, and starts inside a run left out
# unless the match before ended there: the same matches, in linear time and without recursion.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like token: it holds a digit or @; groups of digits that follow belong to it.
_TOKEN = r"""(?<![^\s,;"'<>|=])(?=[^\s,;"'<>|=]*[0-9@])[^\s,;"'<>|=]++(?: [().+-]*+[0-9][0-9().+-]*+)*+"""
#: Words of context that are kept on each side.
_SEEN = 4


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(xs: Column) -> Column:
    """Running sums of a non-empty array of ints, in steps so that long arrays stay cheap."""

    def fold(ys: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(ys, start, lambda s, y: F.struct((s["sum"] + y).alias("sum"), F.concat(s["all"], F.array(s["sum"] + y)).alias("all")), lambda s: s["all"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _STEP).cast("int")), lambda k: fold(F.slice(xs, k * _STEP + 1, F.lit(_STEP))))
    return _let(parts, lambda p: F.flatten(F.zip_with(p, fold(F.transform(p, lambda x: F.element_at(x, -1))), lambda x, top: F.transform(x, lambda y: y + top - F.element_at(x, -1)))))


def found(text: Column, pattern: str) -> Column:
    """array of (start, end, value, left, right): leftmost non-overlapping matches and the text on both sides."""
    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def placed(p: Column) -> Column:
        steps = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["values"])), p["values"], lambda g, v: F.length(g) + F.length(v))
        ends = F.when(F.size(p["values"]) > 0, _running(steps)).otherwise(F.array().cast("array<int>"))
        return F.zip_with(
            ends,
            F.transform(p["values"], lambda v, i: F.struct(v.alias("v"), F.get(p["gaps"], i).alias("l"), F.get(p["gaps"], i + 1).alias("r"))),
            lambda e, x: F.struct((e - F.length(x["v"])).alias("start"), e.alias("end"), x["v"].alias("value"), F.substring_index(F.translate(x["l"], "\t\n\r", "   "), " ", -_SEEN).alias("left"), F.substring_index(F.translate(x["r"], "\t\n\r", "   "), " ", _SEEN).alias("right")),
        )

    return _let(pair, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), lambda p: small(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return _let(_digits(value), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


_RULES = {"email": (_EMAIL, "@"), "ip": (_IP, None), "card": (_CARD, None), "phone": (_PHONE, "+")}


def base_spans(text: Column) -> Column:
    """array of (kind, start, end), kind being the number in KINDS; ordered by kind, then start."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def spans(k: int, kind: str) -> Column:
        pattern, sign = _RULES[kind]
        may = text.contains(sign) if sign else text.rlike("[0-9]")
        good = F.filter(found(text, pattern), lambda m: _valid(kind, m["value"]))
        return F.when(may, F.transform(good, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))).otherwise(none)

    return F.concat(*[spans(k, kind) for k, kind in enumerate(KINDS)])


def _fits(value: Column) -> Column:
    """Kinds that a token's shape allows."""
    n, letters = F.length(_digits(value)), F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
    mixed = (n > 0) & (letters > 0) & (F.length(value) >= 8) & ~value.contains("@") & ~value.contains(".")
    tests = (value.contains("@"), value.rlike(r"[.:][0-9A-Fa-f]*[.:]"), n.between(12, 19) & (letters == 0), n.between(7, 15) & (letters == 0), mixed)
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)]), lambda k: k.isNotNull())


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns: the two words before, the word before, and the words on both sides; a sign that assigns is a word of its own."""
    left = F.regexp_replace(F.regexp_replace(left, r"""["'<(\[]+$""", ""), r"([=:])\s*$", " $1")
    two = F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
    one, after = F.regexp_extract(left, r"(\S+)\s*$", 1), F.regexp_extract(right, r"^\s*(\S+)", 1)
    made = F.array(F.when(two != "", F.concat(F.lit("2 "), two)), F.when(one != "", F.concat(F.lit("1 "), one)), F.when((one != "") & (after != ""), F.concat(F.lit("b "), one, F.lit(" "), after)))
    return F.transform(F.filter(made, lambda p: p.isNotNull()), lambda p: F.lower(p))


def _tokens(text: Column, base: Column) -> Column:
    """array of (start, end, value, kind, fits, patterns): kind is that of a base span that the token overlaps, or null."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,kind:int,fits:array<int>,patterns:array<string>>>")

    def token(m: Column) -> Column:
        core = F.regexp_replace(m["value"], r"[^\p{L}\p{N})]+$", "")

        def trimmed(c: Column) -> Column:
            own = F.regexp_replace(c, r"^[^\p{L}\p{N}+(]+", "")
            end = m["start"] + F.length(c)
            start = end - F.length(own)
            over = F.filter(base, lambda b: (b["start"] < end) & (start < b["end"]))
            kind = F.coalesce(F.get(F.transform(over, lambda b: b["kind"]), F.lit(0)), F.when(own.rlike(_IS_SECRET), F.lit(_SECRET)))
            return F.struct(start.alias("start"), end.alias("end"), F.lower(own).alias("value"), kind.alias("kind"), _fits(own).alias("fits"), _patterns(m["left"], m["right"]).alias("patterns"))

        return _let(core, trimmed)

    return F.when(text.rlike("[0-9@]"), F.filter(F.transform(found(text, _TOKEN), token), lambda t: t["start"] < t["end"])).otherwise(none)


def row_key() -> Column:
    """Names a row by its id and text; rows that agree in both have the same spans."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.hex(F.xxhash64("text")), F.lit(":"), F.coalesce(F.length("text"), F.lit(-1)))


def score_patterns(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, support) from tokens (value, kind, fits, patterns).

    Each turn writes its scores to the shared folder. Sums are made per task
    first, so a word that stands before a third of all tokens is no hot task.
    """
    edges = saved(seen.select("value", F.explode("patterns").alias("pattern")).distinct())
    seeds = seen.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    may = saved(seen.select("value", F.explode(F.when(F.col("kind").isNull(), F.col("fits")).otherwise(F.array("kind"))).alias("kind")).distinct())
    sizes = saved(edges.groupBy("pattern").agg(F.count("*").alias("size")))
    scores = saved(seeds)
    for turn in range(rounds):
        gained = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
        rated = gained.join(sizes, "pattern").select("pattern", "kind", "support", (F.col("support") / (F.col("size") + 1)).alias("confidence"))
        patterns = saved(rated)
        if turn + 1 < rounds:
            strong = patterns.where((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= LEAST_CONFIDENCE / 2))
            reached = edges.join(strong, "pattern").join(may, ["value", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
            scores = saved(seeds.unionByName(reached).groupBy("value", "kind").agg(F.max("score").alias("score")))
    return patterns


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, _key, base, more, seeds: base spans, those that confident patterns add, and secrets that are seeds, for each input row.

    Spans the method adds overlap no base span and are no seeds, and one token
    gets one kind at most: that of its most confident pattern, ties to the
    first kind listed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.select("doc_id", row_key().alias("_key"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = saved(based.select("doc_id", "_key", "base", _tokens(F.col("text"), F.col("base")).alias("tokens")))
    # one row for each key: copies of a row under one id say nothing new
    seen = saved(rows.where(F.size("tokens") > 0).select("_key", F.explode("tokens").alias("t")).select("_key", "t.*").distinct())
    added = marked(seen.where("kind is null"), score_patterns(seen)).select("_key", "start", "end", "kind", F.lit(True).alias("found"))
    seeded = seen.where(F.col("kind") == _SECRET).select("_key", "start", "end", "kind", F.lit(False).alias("found"))
    span = F.struct("kind", "start", "end")
    more = added.unionByName(seeded).groupBy("_key").agg(*[F.sort_array(F.collect_list(F.when(F.col("found") == x, span))).alias(name) for x, name in ((True, "more"), (False, "seeds"))])
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("doc_id", "_key", "base").join(more, "_key", "left").withColumns({c: F.coalesce(c, none) for c in ("more", "seeds")})


def marked(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """_key, start, end, kind of the tokens that a confident pattern marks as a kind that their shape allows."""
    strong = patterns.where((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= LEAST_CONFIDENCE))
    open_ = tokens.where("size(fits) > 0").select("_key", "start", "end", "fits", F.explode("patterns").alias("pattern"))
    best = open_.join(strong, "pattern").where(F.array_contains("fits", F.col("kind"))).groupBy("_key", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
    return best.select("_key", "start", "end", (-F.col("best.k")).cast("int").alias("kind"))


def recovered(docs: DataFrame, hidden: int = HIDDEN) -> DataFrame:
    """kind, n_hidden, n_recovered: of seeds and base spans whose values are hidden (one of `hidden`, by a digest of the value), how many the patterns learnt from the others mark as their kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.select(row_key().alias("_key"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    each = based.select("_key", F.explode(_tokens(F.col("text"), F.col("base"))).alias("t")).select("_key", "t.*")
    seen = saved(each.distinct().withColumns({"was": F.col("kind"), "hides": F.col("kind").isNotNull() & (F.pmod(F.xxhash64("value"), F.lit(hidden)) == 0)}).withColumn("kind", F.when(~F.col("hides"), F.col("kind"))))
    found = marked(seen.where("hides"), score_patterns(seen)).withColumnRenamed("kind", "marked")
    both = seen.where("hides").join(found, ["_key", "start", "end"], "left")
    name = F.get(F.array(*map(F.lit, NAMES)), F.col("was"))
    return both.groupBy(name.alias("kind")).agg(F.count("*").alias("n_hidden"), F.count_if(F.col("marked") == F.col("was")).alias("n_recovered"))


def _written(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*map(F.lit, NAMES)), k)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])))


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_seeds, n_added, base_sha256, spans: one row for each input row.

    n_seeds counts secrets by their shape, n_added what patterns alone mark.
    Null and empty texts have no spans. Repeated rows have the same spans each.
    Columns other than doc_id and text are not read; an empty table gives no
    rows, and with no seeds nothing is added.
    """
    all_ = F.array_sort(F.concat("base", "more", "seeds"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    more = [F.size(c).cast("long").alias(name) for c, name in (("seeds", "n_seeds"), ("more", "n_added"))]
    with scratch(docs.sparkSession):
        return saved(extracted(docs).select("doc_id", *counts, *more, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(all_).alias("spans")), outlives=True)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first's kind.

    Rows without a span are unchanged. Where a text changes, a column n_chars
    is set to its new length.
    """
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))  # no span is without one of these
    with scratch(docs.sparkSession):
        all_ = F.transform(F.concat("base", "more", "seeds"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        marks = extracted(docs.where(may)).select("_key", F.array_sort(all_).alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_key"])
        marks = saved(marks, outlives=True)
    text, spans = F.col("_row.text"), F.col("_spans")

    def put(s: Column, x: Column) -> Column:
        name = F.get(F.array(*[F.lit(f"<{k.upper()}>") for k in NAMES]), x["kind"])
        new = x["start"] >= s["at"]
        gap = F.when(new, F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), name)).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["parts"], F.array(gap)).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    put_in = F.aggregate(spans, start, put, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    # the row travels as one column, so no name of its own can clash
    joined = docs.where(may).select(row_key().alias("_key"), F.struct(*docs.columns).alias("_row")).join(marks, "_key", "left").withColumn("_text", F.when(spans.isNotNull(), put_in))
    own = [F.coalesce("_text", text).alias(c) if c == "text" else F.coalesce(F.length("_text").cast(docs.schema[c].dataType), F.col("_row")[c]).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return joined.select(*own).unionByName(docs.where(~may))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents"))
