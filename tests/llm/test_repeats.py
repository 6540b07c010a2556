"""Substring dedup of words and bytes against brute force."""

import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from lexmill.llm import phrases, repeats, suffixes


def brute(rows, width, words):
    cut = (lambda t: (t or "").encode().split()) if words else (lambda t: [bytes([b]) for b in (t or "").encode()])
    toks = [cut(t) for t in rows]
    seen = Counter(tuple(t[i : i + width]) for t in toks for i in range(len(t) - width + 1))
    out = []
    for t in toks:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[tuple(t[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        left = (b" " if words else b"").join(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}é"[: 1 + i % 5] for i in range(40)]
    common = " ".join(rng.choice(vocab) for _ in range(90))
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 60, 300]))) for _ in range(n)]
    out = [None, "", " \t\n", "a " * 400, "a b " * 150, "x" * 900, "é" * 500]
    for b in base:
        out.append(b)
        if rng.random() < 0.5:  # a copy with an edit
            w = b.split()
            w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
        if rng.random() < 0.3:
            c = common.split()
            k = rng.randrange(len(c))
            out.append(b[:200] + "\n" + " ".join(c[k : k + rng.randrange(20, 90)]) + " " + b[200:])
    return [*out, out[10], out[10]]


@pytest.mark.parametrize("most", [256, 1])
@pytest.mark.parametrize("words", [True, False])
def test_equal_to_brute_force(spark, words, most):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(rows)], "doc_id long, text string, anchor string")
    want = brute(rows, 35 if words else 400, words)
    if words:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.without_repeats(docs, most=most).collect()}
        want = [(a, b, d) for a, b, _, d in want]
    else:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs, most=most).collect()}
    assert [got[i] for i in range(len(rows))] == want


@pytest.mark.parametrize("fn", [phrases.without_repeats, suffixes.without_repeats])
def test_edges(spark, fn):
    assert fn(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = " ".join(f"u{i}" for i in range(150))
    rows = fn(spark.createDataFrame([(None, long), (4, long), (4, long), (5, None)], "doc_id long, text string")).collect()
    assert len(rows) == 4 and [r.n_removed == r[1] for r in rows] == [True] * 4


def test_common_grams_come_last():
    windows = repeats.Windows(35, 6, repeats.word_tokens)
    line = " ".join(f"common{i}" for i in range(20))
    rng = random.Random(3)
    docs = [(" ".join(f"x{rng.random()}" for _ in range(40)) + " " + line + " " + " ".join(f"y{rng.random()}" for _ in range(40))).encode() for _ in range(200)]
    common = tuple(windows.frequent(docs)[0].tolist())
    assert max(Counter(windows.runs(docs)[4].tolist()).values()) > 50
    again = replace(windows, common=common)
    assert common and max(Counter(again.runs(docs)[4].tolist()).values()) == 1
    text, at, n, *_ = again.runs(docs)
    assert sum(n) == sum(len(d.split()) - 34 for d in docs)


def test_family_levels_and_matches():
    rng = np.random.default_rng(4)
    segments = [(1, 20, rng.integers(0, 2, 29).astype(np.uint8).tobytes()) for _ in range(70)]
    got = list(suffixes.matches(segments, 10, 8))
    seen = Counter(s[2][i : i + 10] for s in segments for i in range(20))
    assert [g.tolist() for g in got] == [[seen[s[2][i : i + 10]] > 1 for i in range(20)] for s in segments]
    text = b"".join(s[2] for s in segments)
    family = suffixes.Family(text, 10)
    for i in range(70):
        family.add(np.arange(29 * i, 29 * i + 20))
    assert len(family.levels) <= 7 and sum(n for n, _ in family.levels) == 70
    for _, level in family.levels:  # integer arrays in the order of the suffixes
        assert level.dtype == np.int32 and (found := [text[i : i + 10] for i in level]) == sorted(found)


def test_recurring_passages_are_located():
    """A passage recurs by two segments or by one that stands in several places."""
    words = b" ".join(b"w%d" % i for i in range(40))
    other = b" ".join(b"x%d" % i for i in range(40))
    assert [x.tolist() for x in phrases.locate([(1, 6, words), (1, 6, other), (3, 6, b" ".join(b"y%d" % i for i in range(40)))])] == [[False] * 6, [False] * 6, [True] * 6]
    assert [x.tolist() for x in phrases.locate([(1, 6, words), (1, 6, words.replace(b"w39", b"z"))])] == [[True] * 5 + [False]] * 2


def _morse(n, flip=False):
    """The Thue-Morse word of n letters, on which polynomial hashes modulo a power of two agree with its complement whatever their base."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize("size", [64, 1024, 4096])
def test_words_with_equal_polynomial_hashes_are_not_equal(spark, size):
    words = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([*words, _morse(size)])), (2, " ".join([*words, _morse(size, True)]))], "doc_id long, text string")
    assert [r.n_removed for r in phrases.without_repeats(docs).collect()] == [0, 0]
    tokens = repeats.word_tokens([_morse(size).encode(), _morse(size, True).encode()])
    assert size < 1024 or tokens.values[0] == tokens.values[1]  # routing may still take them for one


def test_long_structured_words_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [_morse(n, f) for n in (16, 512, 1024) for f in (False, True)] + ["ab" * 300, "ba" * 300, "x" * 999, "y"]
    rows = [" ".join(rng.choice(pool) for _ in range(rng.choice([35, 36, 60]))) for _ in range(12)]
    rows += [" ".join([*rows[0].split()[:34], _morse(1024, "b" in rows[0].split()[34][:1])]), rows[3]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for run, width, words in ((phrases.without_repeats, 35, True), (suffixes.without_repeats, 400, False)):
        got = {r.doc_id: r for r in run(docs).collect()}
        for i, (_, removed_, spans, left) in enumerate(brute(rows, width, words)):
            assert (got[i].n_removed, got[i].kept_sha256) == (removed_, left) and (words or got[i].n_spans == spans)
