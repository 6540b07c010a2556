"""SimHash classes against brute force over all pairs."""

import random

import xxhash

from lexmill.llm import simhash


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}é"[: 2 + i % 4] for i in range(60)]
    texts = [None, "", " \t", "One", "one", "ONE two", "\x1c"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == classes(prints)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(classes(prints))


def test_dense_fingerprints_equal_brute_force(spark):
    """Chains and dense balls of fingerprints, which need every step of the join."""
    rng = random.Random(11)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6])):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    got = {r.fp: r.root for r in simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = classes(prints)
    assert len(set(got.values())) == len(set(want))
    for root in set(want):
        assert len({got[signed[i]] for i in range(len(prints)) if want[i] == root}) == 1


def test_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 5), (5, 5), (5, 5)]
