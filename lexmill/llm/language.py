"""Language of each word of code-switched text by a linear-chain conditional random field.

A word's features are the word itself (a lexicon), its affixes and its letter
n-grams, hashed into one weight table; transitions between the languages of
neighbouring words are learnt with them. Training maximises the conditional
likelihood on code-switched sequences that are spliced from spans of a bounded
sample of labelled documents. Labelling runs forward-backward over whole texts,
and a document's language is the one with the most expected words.

Forward-backward over a batch is exact and vectorised: the batch's texts are
one chain whose first-word steps forget what came before; the chain is cut into
about sqrt(n) blocks, whose matrix products carry the state across blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import held_out, learns, mapped, table

#: Labelled documents per language that training reads at most; slots of the weight table; training sequences and their words.
EXAMPLES, SLOTS, SEQUENCES, LENGTH = 300, 1 << 16, 2400, 48
#: Words whose scores a task remembers, and words of text in a batch.
REMEMBERED, BATCH_WORDS = 400_000, 60_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of a place in the chain at most; longer runs, as in scripts without spaces, take several places and as many votes.
PLACE = 40


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    if len(max(found, key=len, default="")) > PLACE:
        return [w[i : i + PLACE] for w in found for i in range(0, len(w), PLACE)]
    return found


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def features(word: str) -> list[int]:
    """Slots of a word: lexicon, prefixes and suffixes up to 3 letters, 3-grams with borders."""
    marked = f"^{word}$"
    names = ["=" + word, "<" + word[:1], "<" + word[:2], "<" + word[:3], ">" + word[-1:], ">" + word[-2:], ">" + word[-3:]]
    names += [marked[i : i + 3] for i in range(len(marked) - 2)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % SLOTS for x in names]


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # slots x languages
    transitions: np.ndarray  # from x to, log scale
    start: np.ndarray

    def emissions(self, word: str) -> np.ndarray:
        f = features(word)
        return self.weights[f].sum(0) / len(f) ** 0.5


def chain_marginals(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of each state at each place of the chain; `first` marks places that begin a text."""
    n, s = emissions.shape
    size = max(1, int(n**0.5))
    blocks = -(-n // size)
    full = blocks * size
    e = np.ones((full, s))
    e[:n] = np.exp(emissions - emissions.max(1, keepdims=True))
    begins = np.ones(full, bool)
    begins[:n] = first
    step = np.where(begins[:, None, None], np.exp(start)[None, None, :], np.exp(transitions)[None]) * e[:, None, :]
    step = step.reshape(blocks, size, s, s)
    whole = step[:, 0]
    for t in range(1, size):
        whole = whole @ step[:, t]
        whole = whole / whole.sum((1, 2), keepdims=True)
    into, out = np.ones((blocks, s)) / s, np.ones((blocks, s)) / s
    for b in range(1, blocks):
        x = into[b - 1] @ whole[b - 1]
        into[b] = x / x.sum()
        y = whole[blocks - b] @ out[blocks - b]
        out[blocks - b - 1] = y / y.sum()
    forward, backward = np.empty((blocks, size, s)), np.empty((blocks, size, s))
    x, y = into, out
    for t in range(size):
        x = np.einsum("bi,bij->bj", x, step[:, t])
        x = x / x.sum(1, keepdims=True)
        forward[:, t] = x
        backward[:, size - 1 - t] = y
        y = np.einsum("bij,bj->bi", step[:, size - 1 - t], y)
        y = y / y.sum(1, keepdims=True)
    post = (forward * backward).reshape(full, s)[:n]
    return post / post.sum(1, keepdims=True)


def _expected_pairs(e: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and summed pair marginals of sequences of one length, e: sequences x length x states."""
    m, n, s = e.shape
    p = np.exp(e - e.max(2, keepdims=True))
    a, t = np.empty_like(p), np.exp(transitions)
    a[:, 0] = np.exp(start) * p[:, 0]
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    for i in range(1, n):
        a[:, i] = (a[:, i - 1] @ t) * p[:, i]
        a[:, i] /= a[:, i].sum(1, keepdims=True)
    b, pairs = np.ones((m, s)), np.zeros((s, s))
    post = np.empty_like(p)
    post[:, n - 1] = a[:, n - 1]
    for i in range(n - 1, 0, -1):
        right = p[:, i] * b
        joint = a[:, i - 1][:, :, None] * t[None] * right[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pairs += joint.sum(0)
        post[:, i - 1] = joint.sum(2)
        b = right @ t.T
        b /= b.sum(1, keepdims=True)
    return post, pairs


def train(examples: list[tuple[str, str]], seed: int = 7) -> Crf:
    """examples: (lang, text). Deterministic for one list; stochastic gradient with AdaGrad steps and a small L2 pull."""
    langs = sorted({lang for lang, _ in examples})
    s = len(langs)
    crf = Crf(langs, np.zeros((SLOTS, s)), np.zeros((s, s)), np.zeros(s))
    if s < 2:
        return crf
    rng = np.random.default_rng(seed)
    texts = [[w for w in (words_of(t) for lang_, t in examples if lang_ == lang) if w] for lang in langs]
    usable = [i for i in range(s) if texts[i]]
    known: dict[str, list[int]] = {}
    g_w, g_t, g_s = np.full((SLOTS, s), 1e-6), np.full((s, s), 1.0), np.full(s, 1.0)
    batch = 48
    for _ in range(SEQUENCES // batch):
        seqs, gold = [], np.empty((batch, LENGTH), int)
        for k in range(batch):
            seq: list[str] = []
            while len(seq) < LENGTH:
                lang = usable[rng.integers(len(usable))]
                text = texts[lang][rng.integers(len(texts[lang]))]
                n = min(int(rng.integers(4, 40)), LENGTH - len(seq), len(text))
                at = int(rng.integers(len(text) - n + 1))
                gold[k, len(seq) : len(seq) + n] = lang
                seq += text[at : at + n]
            seqs.append(seq)
        flat = [w for seq in seqs for w in seq]
        lists = [known[w] if w in known else known.setdefault(w, features(w)) for w in flat]
        sizes = np.array([len(x) for x in lists])
        slots, scale = np.concatenate(lists), np.repeat(1 / np.sqrt(sizes), sizes)
        cuts = np.concatenate(([0], sizes.cumsum()[:-1]))
        e = np.add.reduceat(crf.weights[slots] * scale[:, None], cuts).reshape(batch, LENGTH, s)
        post, pairs = _expected_pairs(e, crf.transitions, crf.start)
        truth = np.eye(s)[gold]
        delta = (truth - post).reshape(-1, s)
        real = np.zeros((s, s))
        np.add.at(real, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        grad = np.zeros((SLOTS, s))
        np.add.at(grad, slots, np.repeat(delta, sizes, axis=0) * scale[:, None])
        grad -= 1e-3 * crf.weights
        for value, g, d, rate in ((crf.weights, g_w, grad, 0.3), (crf.transitions, g_t, real - pairs, 0.3), (crf.start, g_s, (truth - post)[:, 0].sum(0), 0.3)):
            g += d * d
            value += rate * d / np.sqrt(g)
    return crf


def fit(docs: DataFrame, per_language: int = EXAMPLES) -> Crf:
    """Trains on at most `per_language` documents of each language, the first by a hash of their id, among those that may be learnt from.

    Of several texts under one id and language the smallest is taken.
    """
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learns(F.col("doc_id"))).select("doc_id", "lang")
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = may.withColumn("nth", nth).where(F.col("nth") <= per_language).select("doc_id", "lang")
    # at most per_language rows a language, so it may be broadcast and its texts collected
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(few.distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return train([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"])) if has_letter(words_of(r["text"]))])


def word_labels(texts: list[list[str]], crf: Crf, memo: dict[str, int], table_: list[np.ndarray]) -> np.ndarray:
    """Posterior of every word of every text, in one array; memo and table_ remember words' scores between calls."""
    ids = []
    for t in texts:
        for w in t:
            i = memo.get(w)
            if i is None:
                i = memo[w] = len(table_)
                table_.append(crf.emissions(w))
            ids.append(i)
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *map(len, texts[:-1])])] = True
    known = np.array(table_)
    return chain_marginals(known[ids], first, crf.transitions, crf.start)


def labelled(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches of every whole text, one row for each input row.

    lang_pred has the most expected words and score is their share (0 to 1);
    n_switches counts neighbouring words of different languages. Null texts,
    texts without a letter, and everything where no language was learnt give
    `und` and 0. Columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # SLOTS weights for each language

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        model = shared.value
        memo: dict[str, int] = {}
        scores: list[np.ndarray] = []

        def flush(held: list[tuple]) -> Iterator[tuple]:
            nonlocal scores
            texts = [w for _, w in held if w]
            post = word_labels(texts, model, memo, scores) if texts and len(model.langs) > 1 else None
            if len(memo) > REMEMBERED:
                memo.clear()
                scores = []
            at = 0
            for doc_id, w in held:
                if not w or not model.langs:
                    yield doc_id, UNKNOWN, 0.0, len(w), 0
                elif post is None:
                    yield doc_id, model.langs[0], 1.0, len(w), 0
                else:
                    own = post[at : at + len(w)]
                    total = own.mean(0)
                    best = own.argmax(1)
                    yield doc_id, model.langs[int(total.argmax())], float(min(1.0, total.max())), len(w), int((best[1:] != best[:-1]).sum())
                at += len(w)

        held, size = [], 0
        for r in each:
            words = words_of(r["text"])
            held.append((r["doc_id"], words if has_letter(words) else []))
            size += len(words)
            if size >= BATCH_WORDS or len(held) >= 4096:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return mapped(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, n_words long, n_switches long", rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = labelled(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_switches")
