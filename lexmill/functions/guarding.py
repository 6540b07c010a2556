"""Untrusted text as quoted data, what in it is shaped like an instruction, and secrets out of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

_UNSEEN = f"[{fixed.HIDDEN_CHARACTERS}]"
#: Secrets that one pass over the rows takes.
BLOCK = 20_000


def seen(text: Column) -> tuple[Column, Column]:
    """Two views without hidden characters: one with nothing in place of a run of them, one with a space."""
    return F.regexp_replace(text, f"{_UNSEEN}+", ""), F.regexp_replace(text, f"{_UNSEEN}+", " ")


def _runs(text: Column) -> Column:
    """array of (before, size): the characters before each run of hidden ones that are not hidden, and the run's length."""
    runs, gaps = F.regexp_extract_all(text, F.lit(f"({_UNSEEN}+)"), F.lit(1)), F.split(text, f"{_UNSEEN}+", -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    before = F.aggregate(F.slice(gaps, 1, F.size(runs)), empty, lambda s, g: F.struct((s["at"] + F.length(g)).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(g))).alias("all")), lambda s: s["all"])
    return F.zip_with(before, runs, lambda b, r: F.struct(b.alias("before"), F.length(r).alias("size")))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda s, x: s + x)


def flag_places(text: Column) -> Column:
    """array of (label, start, end): of each shape of instruction its first place in the text itself, end exclusive.

    Shapes are looked for in both views, so hidden characters inside a word or
    between two can't part it; a place in a view is mapped back by the hidden
    characters before it.
    """
    text = F.coalesce(text, F.lit(""))
    runs = _runs(text)
    views = seen(text)

    def back(at: Column, spaced: bool) -> Column:
        if not spaced:
            return at + _total(F.transform(F.filter(runs, lambda r: r["before"] <= at), lambda r: r["size"]))
        placed = F.transform(runs, lambda r, i: F.struct((r["before"] + i).alias("before"), r["size"].alias("size")))
        return at + _total(F.transform(F.filter(placed, lambda r: r["before"] < at), lambda r: r["size"] - 1))

    found = []
    for label, shape in fixed.INSTRUCTIONS.items():
        pattern = "(?U)" + shape
        place = None
        for spaced, view in reversed(list(enumerate(views))):
            start = F.regexp_instr(view, F.lit(pattern)) - 1
            last = start + F.length(F.regexp_extract(view, pattern, 0)) - 1
            here = F.struct(F.lit(label).alias("label"), back(start, bool(spaced)).alias("start"), (back(last, bool(spaced)) + 1).alias("end"))
            place = F.when(start >= 0, here) if place is None else F.when(start >= 0, here).otherwise(place)
        found.append(place)
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def flags(text: Column) -> Column:
    """Labels of the shapes of instruction that a text holds."""
    views = seen(F.coalesce(text, F.lit("")))
    shows = lambda shape: views[0].rlike("(?U)" + shape) | views[1].rlike("(?U)" + shape)
    return F.filter(F.array(*[F.when(shows(shape), F.lit(label)) for label, shape in fixed.INSTRUCTIONS.items()]), lambda x: x.isNotNull())


def quoted(name: Column, text: Column, tag: str = "tool_result") -> Column:
    """A text as the untrusted result of a tool: tags that would close the quote and chat control tokens are defused, and both of its own tags carry a mark that is a digest of what it holds."""
    between = f"{_UNSEEN}*".join(tag)
    gap = rf"(?:\s|{_UNSEEN})*"
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{E0000}-\x{E007F}]", "")
    safe = F.replace(F.regexp_replace(bare, f"(?i)<{gap}/({gap}{between})", r"<\\/$1"), F.lit("<|"), F.lit("< |"))
    said = name
    for sign, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        said = F.replace(said, F.lit(sign), F.lit(written))
    mark = F.left(F.sha2(safe, 256), F.lit(fixed.END_MARK))
    return F.concat(F.lit(f'<{tag} name="'), said, F.lit('" trusted="false" end="'), mark, F.lit('">\n'), safe, F.lit(f'\n</{tag} end="'), mark, F.lit('">'))


def masked(text: str, secrets: list[str], may: set[str] | None = None) -> str:
    """text with each secret, in the order given, replaced by the mask until it is not found any more; `may` names those that the text can hold."""
    for secret in secrets:
        if may is None or secret in may or not set(secret).isdisjoint(fixed.MASK):
            while secret in text:
                text = text.replace(secret, fixed.MASK)
    return text


def masking(secrets: list[str]) -> Callable[[Column], Column]:
    """A function of a text column that masks these secrets; one pass of an automaton tells which a text may hold, so few are tried."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        words = ahocorasick.Automaton()
        for secret in secrets:
            words.add_word(secret, secret)
        words.make_automaton()
        risky = [s for s in secrets if not set(s).isdisjoint(fixed.MASK)]
        order = {s: i for i, s in enumerate(secrets)}

        def clean(text: str | None) -> str | None:
            if not text:
                return text
            held = {s for _, s in words.iter(text)}
            # a mask can make a new place only of secrets that have one of its characters
            return masked(text, sorted(held.union(risky), key=order.__getitem__), held) if held else text

        for texts in batches:
            yield texts.map(clean)

    return run


def redacted(rows: DataFrame, secrets: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """rows with every secret (column `secret`) masked in these text columns, longer secrets first, each until none is left.

    Null secrets and parts of the mask itself are ignored. Secrets go to the
    tasks in blocks of bounded size, in their order, a pass for each.
    """
    usable = secrets.select("secret").where("secret is not null").where(~F.lit(fixed.MASK).contains(F.col("secret"))).distinct().orderBy(F.desc(F.length("secret")), "secret")
    held: list[str] = []

    def masked_by(part: list[str], df: DataFrame) -> DataFrame:
        return df.withColumns({c: masking(part)(F.col(c)) for c in columns})

    for r in usable.toLocalIterator():
        held.append(r["secret"])
        if len(held) == block:
            rows, held = masked_by(held, rows), []
    return masked_by(held, rows) if held else rows
