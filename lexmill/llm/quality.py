"""Quality rules: word and line counts, and the fertility of two public tokenisers.

Each text's words are cut by a vocabulary with byte fallback and by a
byte-level one for many languages. Three figures come of either: characters
per token, the share of tokens that are a single byte, and the Shannon entropy
of the token distribution. Each script has fixed bands for what its letters
allow in any language, and bands that are learnt: all figures change with the
length of a text, so each is laid beside a line over the logarithm of the
token count, and a text is rejected whose modified z-score (distance from the
line in units of the median absolute deviation) is out of bounds. A script's
spread is drawn towards a fixed one, as far as its documents are few; there is
no size at which another rule begins. Lines and medians come from sums and
counts over all documents, so they don't depend on how the table is dealt out.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD_RE, saved, scratch, table

VOCABULARY, BYTE_VOCABULARY = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Words that a task remembers; when there are so many, it starts anew.
REMEMBERED = 400_000
#: Texts whose new words are encoded together.
AT_ONCE = 32
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits of a script; entropy is held against log2 of the token count where that is smaller than its full range."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Letters of each script, as ranges of code points, and the bytes that one takes in UTF-8.
SCRIPTS: Mapping[str, tuple[str, int]] = {
    "latin": ("A-Za-z\u00aa-\u024f\u1e00-\u1eff", 1),
    "cyrillic": ("\u0400-\u052f", 2),
    "greek": ("\u0370-\u03ff\u1f00-\u1fff", 2),
    "hebrew": ("\u0590-\u05ff", 2),
    "arabic": ("\u0600-\u06ff\u0750-\u077f", 2),
    "devanagari": ("\u0900-\u097f", 3),
    "thai": ("\u0e00-\u0e7f", 3),
    "kana": ("\u3040-\u30ff", 3),
    "han": ("\u3400-\u9fff", 3),
    "hangul": ("\uac00-\ud7af", 3),
}
#: The vocabulary has words of these scripts, so few of their tokens are bytes.
KNOWN = {"latin": 0.25, "cyrillic": 0.5}


def _band(name: str, width: int) -> Band:
    """Bytes alone give 1 / width characters a token, word marks a little less; half of that is out of reach for text."""
    return Band(1.15 if name == "latin" else 0.5 / width, 9.0, KNOWN.get(name, 1.0), 0.45 if name == "latin" else 0.3)


#: Fixed bands per script; "other" takes letters of none of them.
BANDS: Mapping[str, Band] = {name: _band(name, width) for name, (_, width) in SCRIPTS.items()} | {"other": Band(0.1, 9.0, 1.0, 0.3)}
#: The figures of both vocabularies, with the token count that each goes with, the modified z-scores between which a text is kept,
#: and the spread of a script of which nothing is known. 3.5 is the usual line for outliers; lower limits are those that no labelled good
#: document of the given tables comes near. The first vocabulary's characters per token differ between languages of one script, hence its wide band.
LEARNT: Mapping[str, tuple[str, float, float, float]] = {
    "chars_per_token": ("n_tokens", -9.0, 9.0, 0.15),
    "byte_share": ("n_tokens", -9.0, 12.0, 0.05),
    "token_entropy": ("n_tokens", -4.75, 7.0, 0.3),
    "chars_per_byte_token": ("n_byte_tokens", -5.75, 9.0, 0.15),
    "single_byte_share": ("n_byte_tokens", -9.0, 12.0, 0.05),
    "byte_token_entropy": ("n_byte_tokens", -4.75, 7.0, 0.3),
}
#: Documents that the fixed spread counts as. Steps to which figures are rounded where they are counted.
PRIOR, STEP = 100, 0.005
_OF = {name: re.compile(f"[{letters}]") for name, (letters, _) in SCRIPTS.items()}
_FAR = re.compile("[^\\W\\d_\u0000-\u024f]")


def script_of(text: str) -> str:
    """The script of most of a text's letters, ties going to the first listed; latin if it has none."""
    far = len(_FAR.findall(text))
    if not far:
        return "latin"
    counts = {name: len(p.findall(text)) for name, p in _OF.items()}
    counts["other"] = far - sum(counts.values()) + counts["latin"]
    return max(counts, key=counts.__getitem__)


@cache
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


@cache
def _byte_model(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = list(map(len, ranks))
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def vocabulary() -> tuple[str, str]:
    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(BYTE_VOCABULARY)


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that are found twice or more, first ones included."""
    number: dict[str, int] = {}
    return _repeated(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))


def _repeated(numbers: np.ndarray) -> int:
    """repeated_words() of words given as numbers, equal ones of equal words."""
    n = len(numbers) - 2
    if n < 2:
        return 0
    # exact numbers of windows: in one step while the cube of the words' numbers fits 63 bits, else in two
    size = int(numbers.max()) + 1
    if size < 1 << 20:
        keys = (numbers[:-2] * size + numbers[1:-1]) * size + numbers[2:]
    else:
        keys = np.unique(numbers[:-2] * size + numbers[1:-1], return_inverse=True)[1] * size + numbers[2:]
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, windows, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = counts[windows] > 1
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : k + n] |= often
    return int(covered.sum())


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, n_byte_tokens long, chars_per_byte_token double, single_byte_share double, byte_token_entropy double"


def _fertility(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of single bytes, entropy."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    ordered = np.sort(ids)
    counts = np.diff(np.flatnonzero(ordered[1:] != ordered[:-1]), prepend=-1, append=n - 1) / n
    return n, chars / n, float(is_byte[ids].mean()), float(abs(-(counts * np.log2(counts)).sum()))


class _Lists:
    """Lists of token ids one after another in an array that grows; each has a number, by order."""

    def __init__(self):
        self.flat, self.ends, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        begin, n = self.ends[self.n], self.n + len(sizes)
        if begin + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(flat), np.int32)])
        if n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + len(sizes), np.int64)])
        self.flat[begin : begin + len(flat)] = flat
        self.ends[self.n + 1 : n + 1] = begin + np.cumsum(sizes)
        self.n = n

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of these numbers as one."""
        begin = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begin
        return self.flat[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class _Words:
    """Words that a task has met, with their tokens by both vocabularies."""

    def __init__(self, paths: tuple[str, str]):
        (self.model, self.is_byte), (self.byte_model, self.size) = _model(paths[0]), _byte_model(paths[1])
        self.single = self.size == 1
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pieces, self.bytes = _Lists(), _Lists()

    def meet(self, texts: list[list[str]]) -> None:
        """Encodes the words of these texts that are new."""
        if len(self.number) > REMEMBERED:
            self.forget()
        if new := set().union(*texts).difference(self.number):
            # a space begins a piece of the pre-tokenizer where words hold no white space of their own, so such words are cut at once
            plain, other = [], []
            for w in new:
                (plain if w.isascii() or w.split() == [w] else other).append(w)
            self.number.update(zip(plain + other, range(len(self.number), len(self.number) + len(new)), strict=True))
            self._add(self.pieces, self.model.encode(plain + other, num_threads=1))
            spaced = [f" {w}" for w in plain]
            ids = np.array(self.byte_model.encode_ordinary("".join(spaced)), np.int32)
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in spaced])
            self.bytes.extend(ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1, prepend=0))
            self._add(self.bytes, [self.byte_model.encode_ordinary(f" {w}") for w in other])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words that were met."""
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    @staticmethod
    def _add(lists: _Lists, new: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        lists.extend(np.fromiter(chain.from_iterable(new), np.int32, sizes.sum()), sizes)


def figures(paths: tuple[str, str]) -> Callable[[Column], Column]:
    """A function of a text column: a struct of its counts and of both tokenisers' figures; null texts count as empty."""

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':') for x in FIGURES.split(', '))}>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        met = _Words(paths)

        def one(text: str, words: list[str]) -> tuple:
            lines = Counter(x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c"))
            chars, numbers = sum(map(len, words)), met.numbers(words)
            return len(words), chars, sum(map(text.count, _SYMBOLS)), sum(lines.values()) - len(lines), _repeated(numbers), script_of(text), *_fertility(met.pieces.joined(numbers), chars, met.is_byte), *_fertility(met.bytes.joined(numbers), chars, met.single)

        names = [x.split()[0] for x in FIGURES.split(", ")]
        for texts in batches:
            rows = []
            for i in range(0, len(texts), AT_ONCE):
                some = [t or "" for t in texts[i : i + AT_ONCE]]
                words = list(map(WORD_RE.findall, some))
                met.meet(words)
                rows += map(one, some, words)
            yield pd.DataFrame(rows, columns=names)

    return measured


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _length(m: Column, figure: str) -> Column:
    return F.log2(F.greatest(m[LEARNT[figure][0]], F.lit(1)))


def _medians(counted: DataFrame, value: str, name: str) -> DataFrame:
    """script, figure, name, all: the lower median of `value`, which stands `n` times; counted holds rounded values, so it is small."""
    by = W.partitionBy("script", "figure")
    at = counted.withColumn("below", F.sum("n").over(by.orderBy(value).rowsBetween(W.unboundedPreceding, -1))).withColumn("all", F.sum("n").over(by))
    return at.where(2 * F.coalesce("below", F.lit(0)) < F.col("all")).groupBy("script", "figure").agg(F.max(value).alias(name), F.max("all").alias("all"))


def learnt(measured: DataFrame) -> DataFrame:
    """script, figure, slope, base, spread: lines and spreads of every figure, from all texts (with a column m of figures) that pass the base rules."""
    m = F.col("m")
    own = measured.where(~base_failed(m))
    sums = [x for f in LEARNT for x in (F.regr_slope(m[f], _length(m, f)).alias(f"slope_{f}"), F.regr_intercept(m[f], _length(m, f)).alias(f"base_{f}"), F.avg(m[f]).alias(f"mean_{f}"))]
    fits = saved(own.groupBy(m["script"].alias("script")).agg(*sums))
    # one length only: no line but the mean
    line = lambda f: F.struct(F.lit(f).alias("figure"), F.coalesce(f"slope_{f}", F.lit(0.0)).alias("slope"), F.coalesce(f"base_{f}", f"mean_{f}").alias("base"))
    lines = saved(fits.select("script", F.explode(F.array(*map(line, LEARNT))).alias("x")).select("script", "x.*"))
    each = own.select(m["script"].alias("script"), F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), m[f].alias("value"), _length(m, f).alias("length")) for f in LEARNT])).alias("x")).select("script", "x.*")
    # a row for each script and figure
    off = each.join(F.broadcast(lines), ["script", "figure"]).select("script", "figure", F.round((F.col("value") - F.col("base") - F.col("slope") * F.col("length")) / STEP).cast("int").alias("e"))
    counted = saved(off.groupBy("script", "figure", "e").agg(F.count("*").alias("n")))
    middle = saved(_medians(counted, "e", "median"))
    spread = _medians(counted.join(F.broadcast(middle.select("script", "figure", "median")), ["script", "figure"]).withColumn("off", F.abs(F.col("e") - F.col("median"))), "off", "mad")
    usual = F.create_map(*[F.lit(x) for f, (_, _, _, prior) in LEARNT.items() for x in (f, prior)])
    drawn = (F.col("all") * 1.4826 * F.greatest("mad", F.lit(1)) * STEP + PRIOR * usual[F.col("figure")]) / (F.col("all") + PRIOR)
    both = middle.select("script", "figure", "median").join(spread, ["script", "figure"]).join(lines, ["script", "figure"])
    return both.select("script", "figure", "slope", (F.col("base") + F.col("median") * STEP).alias("base"), drawn.alias("spread"))


def _inside(m: Column, bands: Mapping[str, Band]) -> Column:
    inside = F.lit(False)
    for name, b in bands.items():
        full = F.log2(F.least(F.greatest(m["n_tokens"], F.lit(2)), F.lit(256)))
        inside |= (m["script"] == name) & m["chars_per_token"].between(b.least_chars, b.most_chars) & (m["byte_share"] <= b.most_bytes) & (m["token_entropy"] >= b.least_entropy * full)
    return inside


#: What a rejection is for, and the figures that it goes by.
_REASONS = {"out_chars": ("chars_per_token", "chars_per_byte_token"), "out_bytes": ("byte_share", "single_byte_share"), "out_entropy": ("token_entropy", "byte_token_entropy")}


def _decided(measured: DataFrame, bands: Mapping[str, Band]) -> DataFrame:
    """measured with base_failed, kept, and for each of _REASONS whether it speaks against a text that passes the base rules."""
    m = F.col("m")
    # a row for each script
    found = learnt(measured).groupBy("script").agg(F.map_from_entries(F.collect_list(F.struct("figure", F.struct("slope", "base", "spread")))).alias("_lines"))
    joined = measured.join(F.broadcast(saved(found).withColumnRenamed("script", "_script")), m["script"] == F.col("_script"), "left")

    def outside(figure: str) -> Column:
        line, (_, least, most, _) = F.col("_lines")[figure], LEARNT[figure]
        z = (m[figure] - line["base"] - line["slope"] * _length(m, figure)) / line["spread"]
        return F.coalesce(~z.between(least, most), F.lit(False))

    failed = base_failed(m)
    out = joined.withColumn("base_failed", failed).withColumns({name: ~failed & (outside(a) | outside(b)) for name, (a, b) in _REASONS.items()})
    return out.withColumn("kept", ~failed & _inside(m, bands) & ~F.col("out_chars") & ~F.col("out_bytes") & ~F.col("out_entropy"))


def judged(docs: DataFrame, bands: Mapping[str, Band] = BANDS, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, the figures, base_failed (under 50 words, or over half of them in repeated windows), kept, out_chars, out_bytes, out_entropy: a row for each row.

    kept is false where base_failed is, or where a figure leaves the script's
    fixed band or its learnt one; the last three say by which learnt figure.
    What is learnt depends on all documents of the table, so a text's fate may
    differ between tables. Empty and null texts fail the base rules. Repeated
    rows are judged, and counted, each; an empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    with scratch(docs.sparkSession):
        m = saved(docs.select("doc_id", figures(paths or vocabulary())("text").alias("m")))
        return saved(_decided(m, bands).select("doc_id", "m.*", "base_failed", "kept", *_REASONS), outlives=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def keep_good(docs: DataFrame, bands: Mapping[str, Band] = BANDS, paths: tuple[str, str] | None = None) -> DataFrame:
    """The rows that judged() keeps, all columns unchanged whatever their names; texts are not shuffled."""
    measured = saved(docs.select(F.struct(*docs.columns).alias("row"), figures(paths or vocabulary())(docs["text"]).alias("m")))
    return _decided(measured, bands).where("kept").select("row.*")
