"""English suffix stripping (Porter, 1980) for distinct terms, and word pieces.

A word is seen as a string of c and v (y is a vowel after a consonant); the
measure of a stem is the number of v-c turns in it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes and what they become, in the order in which they are tried.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"ical": "ic", "ness": "", "icate": "ic", "iciti": "ic", "ful": "", "ative": "", "alize": "al"}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for end, new in rules.items():
        if len(word) > len(end) and word.endswith(end):
            base = word[: -len(end)]
            return base + new if _measure(base) > 0 else word
    return word


def _plural_and_past(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        if word.endswith(end):
            base = word[: -len(end)]
            if "v" not in _shape(base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double(base) and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if _measure(base) == 1 and _short_end(base) else base
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; those of fewer than 3 or more than 64 bytes are left alone."""
    if not 3 <= len(word.encode("utf-8", "surrogatepass")) <= 64:
        return word
    word = _plural_and_past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    for end in STEP4:
        if len(word) > len(end) and word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if _measure(word) > 1 and word.endswith("ll") else word


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lru_cache(65536)(stem), na_action="ignore")


def stems_of(terms: DataFrame, column: str = "term") -> DataFrame:
    """(column, stem) of the distinct terms: each is stemmed once, however often it stands in a text."""
    return terms.select(column).distinct().withColumn("stem", stemmed(F.col(column)))


def pieces(words: Column, vocabulary: set[str], most: int = 100) -> Column:
    """Greedy longest pieces of each word; a word with none, or too long, is [UNK]. `vocabulary` has ## before inner pieces."""

    def cut(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None or len(word) > most:
                return ["[UNK]"]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ws: [p for w in (ws if ws is not None else []) for p in cut(w)])

    return each(words)
