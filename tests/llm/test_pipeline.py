"""The pipeline's stages and rows against a brute-force version."""

import random

from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm import bpe
from lexmill.llm.common import table

from .test_pii import brute
from .test_simhash import brute_print, classes


def _redact(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute(text)))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"<{k.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["table", "river", "window", "letter", "morning", "garden", "silver", "harbour", "story", "winter", "people", "market", "yellow", "under", "forest", "candle", "travel", "music", "paper", "stone"] + [f"{a}{b}" for a in ("re", "un", "over", "out") for b in ("turn", "build", "write", "light", "look", "come")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(40)) for i in range(4)]
    rows = []
    for i in range(40):
        text = prose(rng.choice([20, 80, 200]))
        if i % 8 == 1:
            text += " write to some.one@example.com or +1 (743) 555-3824 now"
        if i % 10 == 2:
            text += " " + items[i % 4][1] + " " + prose(30)
        rows.append(text)
    rows += [rows[1], rows[5] + " more", rows[9], "spam words " * 90, "", None]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = [i for i, t in enumerate(rows) if len((t or "").split()) >= 50 and "spam" not in t]
    tops = classes([brute_print(rows[i]) for i in good])
    one = [i for k, i in enumerate(good) if tops[k] == k]
    clean = [i for i in one if not any(x in rows[i] for _, x in items)]
    lib = Tokenizer.from_file(bpe.vocabulary())
    want = {i: len(lib.encode(_redact(rows[i]), add_special_tokens=False).ids) for i in clean}

    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(got) < len(one) < len(good) < len(rows)

    before = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, str(tmp_path))
        assert out.columns == before.columns, name
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Extra columns, also those that a stage uses itself, go through unchanged."""
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("re", "un", "over", "out", "in") for b in ("turn", "build", "write", "light", "look", "come", "side", "land")]
    names = ["_key", "_bad", "_spans", "_row", "_text", "row", "m", "h", "id", "none", "fp", "key", "item", "kept", "_group", "_limits"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(90)) + f" a{i}@b.org", *[f"{n}{i}" for n in names]) for i in range(6)]
    rows += [rows[2], (None, None, *["x"] * len(names)), (7, "", *["x"] * len(names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    spark.createDataFrame([(1, " ".join(words[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = {(r.doc_id, *r[2:]) for r in out.collect()}
        assert kept <= {(r[0], *r[2:]) for r in rows} and {(r[0], *r[2:]) for r in rows[:6]} <= kept, name
