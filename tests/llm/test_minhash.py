"""MinHash classes against brute force over all pairs."""

import random

import numpy as np
import pytest

from lexmill.llm import minhash

SCHEMA = "doc_id long, text string, node string, key string, n string"


def brute_set(text, k=2):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(texts, least=80):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def results(spark, rows):
    docs = spark.createDataFrame([(i, t, t, "k", "n") for i, t in rows], SCHEMA)
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]


def check(spark, texts):
    got = {r[0]: r[1:] for r in results(spark, enumerate(texts))}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(want)]


def edited(rng, words, vocab, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(vocab)
    return " ".join(out)


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}é"[: 2 + i % 5] for i in range(400)]
    texts = [None, "", " \t", "One", "one", "ONE two", "one\ttwo", "one two three", "\x1c", "a " * 300, "a " * 7]
    for _ in range(50):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 12, 60, 700, 4000]))]
        texts += [edited(rng, base, vocab, round(len(base) * share)) for share in rng.sample([0, 0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.2], 3)]
    check(spark, texts)


def test_a_large_group_of_near_copies_and_one_of_copies(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = [edited(rng, base, vocab, rng.randrange(12)) for _ in range(150)] + [" ".join(base)] * 60
    # a chain: each is near the next only
    chain = list(base[::-1])
    for _ in range(25):
        for _ in range(4):
            chain[rng.randrange(len(chain))] = rng.choice(vocab)
        texts.append(" ".join(chain))
    check(spark, texts)


def test_texts_that_share_a_passage_only(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    check(spark, [" ".join(passage + [rng.choice(vocab) for _ in range(25)]) for _ in range(120)])


def test_pairs_within_the_distance_share_a_key(spark):
    """Whatever values differ, DISTANCE of them leave a chunk with ERRORS at most."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        a = rng.integers(0, 1 << 16, minhash.VALUES, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(minhash.VALUES, minhash.DISTANCE, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, len(at), dtype=np.uint16)
        rows.append((i, a.view(np.int64).tolist(), b.view(np.int64).tolist()))
    found = spark.createDataFrame(rows, "i long, a array<long>, b array<long>").select(minhash.keys(minhash.F.col("a")).alias("a"), minhash.keys(minhash.F.col("b")).alias("b"))
    assert all(set(r.a) & set(r.b) for r in found.collect())
    # one more can be placed so that every chunk has two that differ, and no key is shared
    assert minhash.DISTANCE == 15


def test_rows_without_an_id_repeated_rows_and_no_rows(spark):
    text, other = "one two three four five six", "seven eight nine ten"
    got = sorted(results(spark, [(3, text), (3, text), (None, text), (None, other), (None, None), (4, other + " x"), (5, None), (None, "")]), key=repr)
    assert got == sorted([(3, 5, 3, True), (3, 5, 3, True), (None, 5, 3, False), (None, 3, None, True), (None, 0, None, True), (4, 4, 4, True), (5, 0, 5, True), (None, 0, None, True)], key=repr)
    assert results(spark, []) == []


@pytest.mark.parametrize("size", [1, 40, 3000])
def test_signature_differs_as_sets_do(size):
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    assert np.array_equal(minhash.signature(a)[0], minhash.signature(a[::-1])[0])
    if size < 40:
        return
    far = []
    for _ in range(60):
        own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        other = np.unique(np.concatenate((own[: -size // 9], rng.integers(0, 1 << 63, size // 9, dtype=np.uint64))))  # about 0.8
        x, y = (minhash.signature(z)[0].view(np.uint16) for z in (own, other))
        far.append((x != y).mean())
    assert 0.15 < np.mean(far) < 0.25
