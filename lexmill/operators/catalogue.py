"""Incremental ingestion: what changed, and keyed replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small


def diff(listing: DataFrame, held: DataFrame, key: str, stamp: list[str], unlisted: Column | None = None) -> DataFrame:
    """key, outcome: added, changed, unchanged or vanished; stamps are compared null-safely.

    A key for which `unlisted` is true (it lies where nothing could be listed)
    does not vanish, nor does anything if the listing is empty.
    """
    new = listing.select(F.col(key), F.struct(*stamp).alias("new"))
    old = held.select(F.col(key), F.struct(*stamp).alias("old"))
    some = listing.limit(1).count() > 0
    both = new.join(old, key, "full_outer")
    gone = F.lit("kept") if not some else F.lit("vanished") if unlisted is None else F.when(unlisted, "kept").otherwise("vanished")
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), gone).when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return both.select(key, outcome.alias("outcome"))


def replaced(held: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table after rows of `new` have taken the place of those of their keys."""
    return held.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def put(held: DataFrame, new: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """The table after an insert-or-replace of the rows of `new` whose parent is there; others are passed over."""
    return replaced(held, new.join(parents.select(*key), key, "left_semi"), key)


def chunk_rows(wanted: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, chunk: str, document: str, source: str) -> DataFrame:
    """The wanted passages (chunk key and position) with their documents and sources; those gone since are left out."""
    return small(wanted).join(chunks, chunk).join(documents, document).join(small(sources), source)


def looked_up(words: DataFrame, known: DataFrame, word: str, value: str, of_stem: Callable[[Column], Column], guess: Callable[[Column], Column]) -> DataFrame:
    """word, how, value: that of the word in the dictionary, else of its stem before 's, else a guess."""
    stem = F.when(F.col(word).endswith("'s"), F.left(word, F.length(word) - 2))
    own, stems = known.select(word, F.col(value).alias("_own")), known.select(F.col(word).alias("_stem"), F.col(value).alias("_of_stem"))
    both = words.join(own, word, "left").join(stems, stem == F.col("_stem"), "left")
    how = F.when(F.col("_own").isNotNull(), "known").when(F.col("_of_stem").isNotNull(), "possessive").otherwise("guessed")
    return both.select(word, how.alias("how"), F.coalesce("_own", of_stem(F.col("_of_stem")), guess(F.col(word))).alias(value))


def missing(rows: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Rows that nothing was made for yet."""
    return rows.join(made.select(key), key, "left_anti")


def under(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies under it, without regard to case."""
    low = F.lower(path)
    return (low == folder.lower()) | low.startswith(folder.lower() + "/")


def recipe(splitter: str, max_tokens: int, lines: int, reader: int = 1, rules: int = 2) -> str:
    return f"{splitter}/{max_tokens}/{lines}/r{reader}/s{rules}"
