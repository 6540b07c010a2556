"""Alignment of letters and sounds against enumeration of all paths."""

import math
import random
from collections import Counter
from itertools import product

from lexmill.functions import fixed
from lexmill.operators import alignment
from lexmill.plans import catalog


def ways(letters, sounds):
    for takes in product(range(3), repeat=len(letters)):
        if sum(takes) == len(sounds):
            ends = [sum(takes[: i + 1]) for i in range(len(takes))]
            yield [tuple(sounds[e - t : e]) for e, t in zip(ends, takes, strict=True)], math.prod(fixed.SOUND_WEIGHTS[t] for t in takes)


def test_expected_counts_and_best_paths_equal_enumeration():
    rng = random.Random(1)
    for _ in range(60):
        letters, sounds = [rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("XYZ") for _ in range(rng.randrange(9))]
        all_ = list(ways(letters, sounds))
        want = Counter()
        for outputs, weight in all_:
            for pair in zip(letters, outputs, strict=True):
                want[pair] += weight / sum(w for _, w in all_)
        got = alignment.expected(letters, sounds)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
        scores = {k: -rng.random() for k in list(want)[::2]}
        found = alignment.best_path(letters, sounds, scores)
        totals = [sum(scores.get(p, fixed.UNSEEN) for p in zip(letters, o, strict=True)) for o, _ in all_]
        assert (found is None) == (not all_)
        if found:
            assert math.isclose(found[1], max(totals), abs_tol=1e-9) and found[0] in [o for o, _ in all_]


def test_rounds_learn_the_rule(spark):
    rng = random.Random(3)
    rule = {"a": ["A"], "b": ["B"], "x": ["K", "S"], "e": [], "t": ["T"]}
    words = {"".join(rng.choice("abxet") for _ in range(rng.randrange(1, 9))) for _ in range(400)}
    rows = [(w, list(w), [s for c in w for s in rule[c]]) for w in sorted(words)] + [("no", ["n"], ["A", "B", "C"]), ("null", None, [])]
    held, told = alignment.aligned(spark.createDataFrame(rows, "word string, letters array<string>, sounds array<string>"))
    got = {r.word: r.outputs for r in held.collect()}
    assert got.keys() == words and 2 <= len(told) <= 10 and all(b >= a - 1e-6 for a, b in zip(told[1:], told[2:], strict=False))
    right = sum(got[w] == [rule[c] for c in w] for w in words)
    assert right >= 0.95 * len(words)
    assert alignment.aligned(spark.createDataFrame([], "word string, letters array<string>, sounds array<string>"))[0].collect() == []


def test_ways_of_long_words_are_counted():
    # a product of so many weights is no float above zero; two sounds for each letter is the only way
    got = alignment.expected("ab" * 200, "XYZT" * 200)
    assert got.keys() == {("a", ("X", "Y")), ("b", ("Z", "T"))} and all(math.isclose(n, 200, rel_tol=1e-6) for n in got.values())


def test_words_of_a_batch_equal_words_alone(monkeypatch):
    rng = random.Random(5)
    words = [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("XYZ") for _ in range(rng.randrange(9))]) for _ in range(300)]
    scores = {(a, b): -rng.random() for a in "abd" for b in ((), ("X",), ("Y", "Z"), ("Q",), ("X", "X"))}
    want, taken, paths = Counter(), Counter(), []
    for letters, sounds in words:
        want.update(alignment.expected(letters, sounds))
        if found := alignment.best_path(letters, sounds, scores):
            taken.update(zip(letters, found[0], strict=True))
            paths.append(found)
    kind = alignment.pa.list_(alignment.pa.string())
    for limits in ((1 << 20, 1 << 18), (50, 0)):
        monkeypatch.setattr(alignment, "CELLS", limits[0])
        monkeypatch.setattr(alignment, "DENSE", limits[1])
        batch = alignment._alignable(alignment.pa.record_batch([alignment.pa.array(x, kind) for x in zip(*words, strict=True)], ["letters", "sounds"]))
        b = alignment._Batch(batch["letters"], batch["sounds"])
        got = {(x, tuple(y)): n for x, y, n in b.pairs(alignment._expected(b))}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
        takes, totals = alignment._best(b, scores)
        assert totals.tolist() == [t for _, t in paths] and takes.tolist() == [len(o) for p, _ in paths for o in p]
        assert {(x, tuple(y)): n for x, y, n in b.pairs(alignment._taken(b, takes))} == taken


def test_aligned_words_joins_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "Size, exact sizes; x-ray: zero"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["aligned_words"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().toString() and found.first().n_words == 6
