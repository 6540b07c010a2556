"""The filter audit against every order run over every document."""

import random
from itertools import permutations

from lexmill.llm import interactions

SCHEMA = "doc_id long, text string, lang string, quality int, mask string, part string"


def fails(rows):
    out = []
    for i, (doc, text, _) in enumerate(rows):
        text = text or ""
        split = text
        for c in "\t\n\x0b\x0c\r":
            split = split.replace(c, " ")
        words = [w for w in split.split(" ") if w]
        out.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for j, (d, t, _) in enumerate(rows) if j != i),
        })
    return out


def brute(rows, labels):
    marks = fails(rows)
    good, bad = ({d for d, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    out = {}
    for part in {p or "" for _, _, p in rows}:
        own = [(d, m) for (d, _, p), m in zip(rows, marks, strict=True) if (p or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(m[f] for _, m in own) - len(gone), sum(m[f] and sum(m.values()) == 1 for _, m in own),
                    sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7, "m", "p") for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    found = interactions.audited(docs, marks).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(out) == len(found)
    return out


def test_equal_to_every_order_over_every_document(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "A B", "x " * 120, "\t\n".join(f"w{i}" for i in range(130)), "é" * 20 + " #", " ".join(f"W{i}X" for i in range(140)), " ".join(f"v{i}" for i in range(40_000))]
    for _ in range(30):
        n, kinds = rng.choice([20, 99, 100, 101, 300]), rng.choice([30, 90, 5000])
        texts.append(" ".join(f"{rng.choice('aAbé')}{rng.randrange(kinds)}" for _ in range(n)) + rng.choice(["", "$", "|", "\v"]))
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(200)]
    rows += [(None, texts[4], "en"), (None, texts[4], "en"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], "fr"), (-5, rows[9][1], "en"), (7, None, None)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in rng.sample(range(200), 90)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (999, 1, 1)]
    labelled = [x for x in labels if x[0] is not None]
    assert audit(spark, rows, labels) == brute(rows, labelled)


def test_one_text_for_most_rows(spark):
    rows = [(i, "same text " * 60 if i % 4 else f"own {i} " * 60, "en" if i % 3 else None) for i in range(400)]
    assert audit(spark, rows, [(i, i % 2, 1 - i % 2) for i in range(0, 400, 3)]) == brute(rows, [(i, i % 2, 1 - i % 2) for i in range(0, 400, 3)])


def test_no_rows_and_no_labels(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "a", "en"), (2, "a", "en")]
    assert audit(spark, rows, []) == brute(rows, [])
