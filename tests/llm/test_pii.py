"""PII: base spans against a brute-force version, and what contexts add."""

import hashlib
import random
import re

import pytest

from lexmill.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, value):
    digits = re.sub(r"\D", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else 2 * int(d) - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if _passes(k, m[0])]


def _texts():
    rng = random.Random(5)
    parts = ["a@b.c", "a@b.c_x@y.z", "x.y@z", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "00255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "4111111111111111 4111111111111111", "+1 (743) 555-3824", "+1-", "++12 34 56 78 9", "é", "𝒳", "\n", " ", ".", "-", "_", "%", "word", "12", "0", "a.a.a", "+49.30.1234567)", "99999999999999999999999.1.1.1"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    return [*out, None, "", "7" * 5000, "1 " * 3000, "a@b.c " * 700, "a." * 4000, "1.2.3.4 " * 300]


def test_base_spans_equal_brute_force(spark):
    texts = _texts()
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.spans_of(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, got[i].spans, want)
        assert [getattr(got[i], f"n_{k}") for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(filter(None, got[i].spans.split(",")))


def test_contexts_add_unseen_identifiers(spark):
    seen = [(i, f"Words before. Reach me by telephone +1 (743) 555-{1000 + i} any time") for i in range(30)]
    odd = [(100, "Then she said call by telephone 555-443-2211 any time"), (101, "There were 555-443-2212 of them"), (None, "x by telephone 555-443-2299 any time"), (7, None)]
    noise = [(200 + i, f"There were {5000000 + i} of them") for i in range(30)]
    rows = spark.createDataFrame([*seen, *odd, *noise], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans_of(rows).collect()}
    assert got[100].spans == "phone:32:44"
    assert got[None].n_added == 1
    assert got[101].n_added == 0 and all(got[200 + i].n_added == 0 for i in range(30))
    clean = {r.doc_id: r.text for r in pii.redacted(rows).collect()}
    assert clean[100] == "Then she said call by telephone <PHONE> any time"
    assert clean[3].endswith("by telephone <PHONE> any time") and clean[101] == odd[1][1]


def test_redaction_merges_overlaps_and_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "é a@1.2.3.4 z", 11, 9), (1, "é a@1.2.3.4 z", 11, 9), (2, None, 0, 9), (3, "clean", 5, 9)], "doc_id long, text string, n_chars long, start int")
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in pii.redacted(rows).collect())
    assert got == [(1, "é <EMAIL> z", 11), (1, "é <EMAIL> z", 11), (2, "", 0), (3, "clean", 5)]


@pytest.mark.parametrize("fn", [pii.spans_of, pii.redacted])
def test_empty_table(spark, fn):
    assert fn(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pattern_scores_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        kind = rng.choice([None, None, 0, 3])
        rows.append((f"v{i % 150}", kind, [0, 3] if kind is None else [kind], rng.sample([f"p{k}" for k in range(12)], 2)))
    seen = spark.createDataFrame(rows, "value string, kind int, fits array<int>, patterns array<string>")
    got = {(r.pattern, r.kind): (round(r.confidence, 9), round(r.support, 9)) for r in pii.score_patterns(seen).collect()}

    edges = {(v, p) for v, _, _, ps in rows for p in ps}
    seeds = {(v, k): 1.0 for v, k, _, _ in rows if k is not None}
    may = {(v, k) for v, k, fits, _ in rows for k in (fits if k is None else [k])}
    size = {p: sum(q == p for _, q in edges) for _, p in edges}
    scores = dict(seeds)
    for turn in range(pii.ROUNDS):
        support = {}
        for v, p in edges:
            for k in (0, 3):
                if (v, k) in scores:
                    support[p, k] = support.get((p, k), 0) + scores[v, k]
        patterns = {pk: (s / (size[pk[0]] + 1), s) for pk, s in support.items()}
        if turn + 1 < pii.ROUNDS:
            scores = dict(seeds)
            for v, k in may:
                miss = 1.0
                hit = [patterns[p, k][0] for w, p in edges if w == v and (p, k) in patterns and patterns[p, k][1] >= pii.LEAST_SUPPORT and patterns[p, k][0] >= pii.LEAST_CONFIDENCE / 2]
                for c in hit:
                    miss *= 1 - c
                if hit:
                    scores[v, k] = max(scores.get((v, k), 0), 1 - miss)
    assert got == {pk: (round(c, 9), round(s, 9)) for pk, (c, s) in patterns.items()}


def test_patterns_recover_hidden_identifiers(spark):
    """Of identifiers in one context some look like seeds; the others are what the patterns must find."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([4, 9, 120])))
    rows, hidden = [], set()
    for i in range(80):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if i % 2 else "k" + str(i) + "".join(rng.choice("ghijkmnp0123456789") for _ in range(9)) + "7z"
        text = f'{word()} {word()} token = "{value}" {word()}'
        if not i % 2:
            hidden.add((i, f"secret:{text.index(value)}:{text.index(value) + len(value)}"))
        rows.append((i, text, "k", [1]))
    rows += [(500 + i, f"{word()} room number {rng.randrange(10**8)}x {word()}", "k", [1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _spans array<int>")
    counts = {r.doc_id: (r.n_seeds, r.n_added) for r in pii.spans_of(docs).collect()}
    assert all(counts[i] == ((1, 0) if i % 2 else (0, 1)) for i in range(80))
    told = {r.kind: (r.n_hidden, r.n_recovered) for r in pii.recovered(docs).collect()}
    assert told["secret"][0] == told["secret"][1] > 0
    got = {(r.doc_id, s) for r in pii.spans_of(docs).collect() for s in r.spans.split(",") if s}
    assert hidden <= got and all(i < 500 for i, _ in got) and len(got) == 80
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert all('token = "<SECRET>"' in out[i].text and out[i]._key == "k" and out[i]._spans == [1] for i in range(80)) and out[500].text == rows[80][1]


def test_patterns_spread_from_one_assignment_to_another(spark):
    """A sign that assigns is a context of its own, so values under a name that no seed has are reached in turns; numbers beside it are not."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    mixed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    rows = [(i, f'{word()} token = "{mixed(40)}" {word()}') for i in range(40)] + [(100 + i, f"{word()} password={mixed(18)} {word()}") for i in range(40)] + [(200, "width=300 x"), (201, "see k=12345678 y")]
    got = {r.doc_id: (r.n_seeds, r.n_added) for r in pii.spans_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (1, 0) for i in range(40)) and all(got[100 + i] == (0, 1) for i in range(40)) and got[200] == got[201] == (0, 0)
