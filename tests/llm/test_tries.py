"""The conversation trie against brute force over every prefix."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from lexmill.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, pos long, name string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        own.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for seq, members in nodes.items():
        under = [s for s in nodes if s[: len(seq)] == seq]
        kids = lambda s: [x for x in nodes if len(x) == len(s) + 1 and x[: len(s)] == s]
        ends = sorted(c for c in members if len(convs[c]) == len(seq))
        out.append((
            min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids(seq)), sum(not kids(s) for s in under),
            sum((len(nodes[s]) - 1) * (len(s[-1][1].encode()) if s else 0) for s in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie(spark, rows, first=tries.FIRST):
    made = spark.createDataFrame([(*r, "d", 5, "n") for r in rows], SCHEMA)
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in tries.trie(made, first).collect()), key=repr)


def conversations(seed, n=60, words=3, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "é", "long text " * words, "b"][: rng.choice([2, 5])])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, first", [(1, 1), (2, 32)])
def test_equal_to_brute_force(spark, seed, first):
    rows = conversations(seed)
    assert trie(spark, rows, first) == brute(rows)


def test_copies_and_one_long_conversation(spark):
    """Whole groups of the same conversations, over several blocks, and one that has a third of all turns."""
    rng = random.Random(9)
    rows = []
    for c in range(300):
        of = rng.choice([0, 0, 1, 2])
        rows += [(c, t, "user", f"turn {of} {t}") for t in range(12 + of)]
    rows += [(1000, t, "user", f"only {t % 7}") for t in range(1500)]
    rows += [(1005, t, "user", f"only {t % 7}") for t in range(60)]
    assert trie(spark, rows) == brute(rows)


def test_one_chain_no_turns_and_no_rows(spark):
    assert trie(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(7, 1, "user", "a")], [(7, None, None, None)] * 12, [(10 + i, t, "u", "x") for i in range(5) for t in range(10)]):
        assert trie(spark, rows) == brute(rows)


def test_nearest_smaller_and_least(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100):
        x = rng.integers(0, 6, n)
        assert tries.smaller_before(x).tolist() == [max([j for j in range(i) if x[j] < x[i]], default=-1) for i in range(n)]
        lo, hi = zip(*[(a, b) for a in range(n) for b in range(a + 1, n + 1)], strict=True)
        assert tries._Least(x).of(np.array(lo), np.array(hi)).tolist() == [x[a:b].min() for a, b in zip(lo, hi, strict=True)]
