"""Decontamination, quality, WARC, language, BPE and toxicity on fixtures and against brute force."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from lexmill.llm import bpe, decontaminate, language, quality, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


def test_decontamination_finds_substituted_passages_and_leaves_clean_documents(spark):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(300)]
    items = [(i, _prose(rng, rng.choice([15, 30, 60]), vocab)) for i in range(20)] + [(90, None), (91, "too short"), (92, "")]
    docs, want = [], set()
    for i, (item, text) in enumerate(items[:20]):
        words = text.split()
        for k in range(0, len(words), 8):
            words[k] = "changed"
        docs.append((i, _prose(rng, 40, vocab) + ", " + " ".join(words).upper() + ".\n" + _prose(rng, 20, vocab), i))
        want.add((i, item))
    docs += [(100 + i, _prose(rng, 200, vocab), 0) for i in range(40)] + [(200, None, 0), (201, "", 0), (None, items[3][1], 0), (5, docs[5][1], 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == want | {(None, 3)}
    kept = decontaminate.without_overlaps(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(100, 140), 200, 201]
    assert {(r._key, r.item_id) for r in decontaminate.hits(docs, bench, docs["doc_id"], bound=1).collect()} == got
    assert decontaminate.overlaps(docs, bench.limit(0)).collect() == [] and decontaminate.without_overlaps(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.overlaps(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("bound", [decontaminate.MOST_BROADCAST, 1])
def test_decontamination_finds_parts_of_items(spark, bound):
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(3000)]
    items = [(i, _prose(rng, n, vocab)) for i, n in enumerate([38, 38, 38, 11, 1400])]
    words = [t.split() for _, t in items]
    around = lambda x: " ".join([_prose(rng, 30, vocab), *x, _prose(rng, 30, vocab)])
    docs, want = [], set()
    for at in range(26):  # every quote of 13 tokens
        docs.append((at, around(words[0][at : at + 13])))
        want.add((at, 0))
    for at in range(0, 19, 3):  # 20 tokens, three of them changed
        quote = words[1][at : at + 20]
        for k in (3, 16, 18):
            quote[k] = "changed"
        docs.append((100 + at, around(quote)))
        want.add((100 + at, 1))
    docs += [(200, around(words[2][5:14])), (201, around(words[3])), (202, " ".join(words[2][20:33])), (203, around(words[4][1300:1320])), (205, " ".join(words[2][20:32]) + " " + _prose(rng, 30, vocab)), (204, _prose(rng, 2000, vocab) + " " + " ".join(words[4][700:720]))]
    want |= {(201, 3), (202, 2), (205, 2), (203, 4), (204, 4)}
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.hits(docs, spark.createDataFrame(items, "item_id long, text string"), docs["doc_id"], bound=bound).collect()
    assert {(r._key, r.item_id) for r in got} == want
    assert all(0.75 <= r.share <= 1 and 9 <= r.n_equal <= 25 for r in got)


def _base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_base_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = ["the", "of", "a#b", "é", "*", "\x1c", "x|y"]
    texts = [None, "", " \n\t", "a b a b a b", "x\nx\n y\nx", "# # # #"] + ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", " \x0b"]) for _ in range(rng.randrange(120))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, m int")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], _base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert sorted(x.doc_id for x in quality.keep_good(docs).collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality.keep_good(docs).columns == docs.columns and quality.judged(docs.limit(0)).collect() == []


def test_quality_bands(spark):
    prose = "When the traveller came down from the mountain he found that all of his friends had gone away to the coast, where the summer market was held each year, and so he sat beside the well, ate some bread, and wrote a long letter to his sister about everything he had seen among the snow and the old stone towers. "
    docs = spark.createDataFrame([(1, prose), (2, " ".join("𐀀𐀁𐀂"[i % 3] + "𐂀" * (i % 5) + chr(97 + i % 26) + chr(97 + i % 7) for i in range(80))), (3, " ".join("q" * (i + 60) for i in range(70)))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert got[1].kept and got[1].byte_share == 0 and got[2].byte_share > 0.5 and not got[3].kept


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(6)
    letters = "abcdefgXYZ0123 é ß İ 中 ' ’s don't <|endoftext|> \n\t\x00   😀 ... !!! ́"
    texts = [None, "", " ", "Hello World's 2024!", "<|startoftext|>x", "a" * 3000, "ſtrange K ı", "naïve café"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    whole = {r.doc_id: r for r in bpe.tokens(docs).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert whole[i].ids == ids and whole[i].decoded == text, t
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(docs.limit(0)).collect() == []


def _overlaps(doc, item):
    """Whether some stretch is good, straight from the rule: every diagonal is tried, whatever the masks meet."""
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    d, b = tokens(doc), tokens(item)
    if len(b) < decontaminate.LEAST_EQUAL:
        return len(b) >= decontaminate.LEAST_SHORT and any(d[i : i + len(b)] == b for i in range(len(d)))
    for start in range(-len(b), len(d)):
        same = [0 <= start + i < len(d) and d[start + i] == b[i] for i in range(len(b))]
        if sum(same) < decontaminate.LEAST_EQUAL:
            continue
        least = min(len(b), decontaminate.LEAST_STRETCH)
        for n in range(least, min(2 * least - 1, len(b)) + 1):
            for i in range(len(b) - n + 1):
                if sum(same[i : i + n]) >= max(decontaminate.LEAST_EQUAL, decontaminate.LEAST_SHARE * n):
                    return True
    return False


@pytest.mark.parametrize("n", range(9, 26))
def test_masks_meet_every_placing_of_unequal_tokens(n):
    """Of the most unequal tokens that a good stretch of n may have, in all places, some mask lies on equal ones only."""
    most = min(n - decontaminate.LEAST_EQUAL, int(n * (1 - decontaminate.LEAST_SHARE)))
    placed = np.array([sum(1 << i for i in c) for c in combinations(range(n), most)], np.int64)
    met = np.zeros(len(placed), bool)
    for mask in decontaminate.MASKS:
        bits = sum(1 << i for i, bit in enumerate(mask) if bit == "1")
        for shift in range(n - len(mask) + 1):
            met |= (bits << shift) & placed == 0
    assert met.all()


@pytest.mark.parametrize("bound", [200_000, 1])
def test_all_passages_at_the_line_are_found(spark, bound):
    """Ten of 13 tokens equal, in every placing, inside unlike text; and one fewer, of which none is reported."""
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(5000)]
    item = rng.sample(vocab, 30)
    docs = []
    for unequal in (3, 4):
        for k, c in enumerate(combinations(range(13), unequal)):
            part = ["other" + str(i) if i in c else w for i, w in enumerate(item[8:21])]
            docs.append((1000 * unequal + k, " ".join([f"a{rng.randrange(10**6)}" for _ in range(9)] + part + [f"b{rng.randrange(10**6)}" for _ in range(9)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r._key for r in decontaminate.hits(frame, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), frame["doc_id"], bound).collect()}
    assert got == {i for i, _ in docs if i < 4000} and len(got) == 286


def test_decontamination_equals_brute_force(spark, monkeypatch):
    """Parts of items with substitutions at the seams of blocks, short items, long texts, a common word, clashing names."""
    monkeypatch.setattr(decontaminate, "BLOCK", 16)
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(12)]
    items = [(i, _prose(rng, rng.choice([5, 8, 12, 25]), vocab)) for i in range(14)] + [(50, "v1 v2"), (51, None), (52, "the " * 12)]
    docs = []
    for i in range(60):
        words = _prose(rng, rng.choice([0, 9, 30, 120]), vocab).split()
        part = rng.choice(items[:14])[1].split()
        part = part[rng.randrange(3) : len(part) - rng.randrange(3)]
        if part and rng.random() < 0.5:
            part[rng.randrange(len(part))] = "other"
        at = rng.randrange(len(words) + 1)
        docs.append((i, " ".join(words[:at] + part + words[at:]), "k", "b"))
    docs += [(70, "the " * 3000, "k", "b"), (71, None, "k", "b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, _key string, _bad string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, t, _, _ in docs for k, item in items if _overlaps(t, item)}
    for bound in (200_000, 1):
        assert {(r._key, r.item_id) for r in decontaminate.hits(frame, bench, frame["doc_id"], bound).collect()} == want
    assert 10 < len(want) and {r.doc_id for r in decontaminate.without_overlaps(frame, bench).collect()} == {i for i, *_ in docs} - {i for i, _ in want}
    assert decontaminate.without_overlaps(frame, bench).columns == frame.columns


def test_warc_index_of_many_blocks(spark):
    """Several blocks and files, keys that repeat across a block's end, long payloads, records as others can read them."""
    rng = random.Random(3)
    pages = [(i, f"http://h{rng.randrange(9)}.example.org/p?q={rng.randrange(40)} é\n", rng.choice(["", "<p>" + str(i % 7) * 300, "x" * 200_000 if i % 50 == 0 else str(i)])) for i in range(300)]
    pages += [pages[0]] * 9
    docs = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, key string, first long")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to if r.refers_to is not None else -1) for r in warc.round_trip(docs, block_lines=4).collect())
    first = {}
    for i, _, html in pages:
        first[html] = min(i, first.get(html, i))
    want = sorted((i, len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if len(h) >= 100 and first[h] != i else "response", first[h] if len(h) >= 100 and first[h] != i else -1) for i, _, h in pages)
    assert got == want
    fields, body = warc.parse(warc.record(7, "http://a/ü b\r\nX: y", b"zz", "d", "f/0", None, None))
    assert body == b"zz" and fields["WARC-Target-URI"] == "http://a/%C3%BC%20b%0D%0AX:%20y" and len({warc.parse(warc.record(7, None, b"", "d", f"f/{at}", None, None))[0]["WARC-Record-ID"] for at in range(3)}) == 3


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 200
    pages = [(5, "http://B.example.com/a?x=1", long), (2, "http://a.example.com/", long), (9, None, long), (1, "http://a.example.com/", "short"), (3, "u", "short"), (4, "http://c.org:80/é", None), (6, "http://c.org", ""), (2, "http://a.example.com/", long), (None, "n", long)]
    docs = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int")
    got = warc.round_trip(docs).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert all((r.payload_bytes, r.payload_digest) == (203, digest) for i in (5, 2, 9, None) for r in by[i])
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(5, "revisit", 2), (2, "response", None), (9, "revisit", 2), (1, "response", None), (3, "response", None), (4, "response", None), (6, "response", None), (None, "revisit", 2)}
    assert len(by[2]) == 2 and by[4][0].payload_bytes == 0
    assert warc.round_trip(docs.limit(0)).collect() == []
    assert warc.url_key("https://News.Example.com/x?q#f").startswith("com,example,news)")


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_of_code_switched_text(spark):
    rng = random.Random(4)
    vocab = {"en": ["the", "thing", "of", "with", "other", "when", "those", "wash"], "de": ["der", "schön", "und", "nicht", "gegen", "schule", "auf"], "es": ["que", "para", "los", "niño", "como", "ellos", "cuando"]}
    rows = [(i, lang, _prose(rng, 60, vocab[lang])) for i, lang in enumerate(["en", "de", "es"] * 40)]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, lang, t in rows] + [(900, None, "en", "s"), (901, "12 34", "en", "s"), (902, "the thing of der und nicht gegen schule auf und nicht", None, "s")], "doc_id long, text string, lang string, source string")
    crf = language.fit(docs)
    got = {r.doc_id: r for r in language.labelled(docs, crf).collect()}
    assert all(got[i].lang_pred == lang for i, lang, _ in rows if _held(i)) and got[900].lang_pred == got[901].lang_pred == "und"
    assert got[902].lang_pred == "de" and got[902].n_switches == 1
    none = language.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language.labelled(docs, none).collect()} == {"und"} and language.labelled(docs.limit(0), crf).collect() == []


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    e, t, s = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([True, False, False, True, False, False])
    want = np.zeros((6, 3))
    for path in itertools.product(range(3), repeat=6):
        w = np.exp(sum(e[i, y] + (s[y] if first[i] else t[path[i - 1], y]) for i, y in enumerate(path)))
        for i, y in enumerate(path):
            want[i, y] += w
    assert np.allclose(language.chain_marginals(e, first, t, s), want / want.sum(1, keepdims=True))


def test_language_of_long_runs_and_odd_rows(spark):
    """Runs of letters longer than a place are cut, not shortened; clashing names and repeated ids do no harm."""
    assert language.words_of("ab " + "x" * 95) == ["ab", "x" * 40, "x" * 40, "x" * 15]
    rows = [(i, "aa bb ab " * 30 if i % 2 else "cc dd cd " * 30, "p" if i % 2 else "q", 0.5, True) for i in range(40)] + [(1, "bb aa", "p", None, None), (800, "cdcdcccd" * 4000, None, None, None), (801, "cc dd " * 60_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean")
    got = language.labelled(docs, language.fit(docs)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.lang_pred for r in got if r.doc_id >= 800} == {800: "q", 801: "q"}
    assert {r.n_words for r in got if r.doc_id == 800} == {800}


def test_toxicity_neighbours_are_exact_and_learn(spark):
    rng = random.Random(9)
    vocab = [f"w{i}x".replace("0", "o").replace("1", "i") for i in range(60)]
    bad = ["idiot", "scum", "vile"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [rng.choice(vocab) for _ in range(40)]
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model, found = toxicity.fit(docs, spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.scored(found, model).collect()}
    held = [i for i in range(400) if _held(i)]
    right = sum((got[i].score >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held) and 0 <= got[900].score <= 1 and got[901].score == got[900].score
    ix = model.index
    vectors = {i: ix.vector_of(rows[i][1]) for i in range(400)}
    by_term = {i: dict(zip(*map(np.ndarray.tolist, v), strict=True)) for i, v in vectors.items()}
    for q in range(0, 400, 37):
        cosine = [(round(sum(w * by_term[d].get(t, 0) for t, w in by_term[q].items()), 9), -k) for k, d in enumerate(ix.ids)]
        want = [-k for c, k in sorted(cosine, reverse=True) if c > 0]
        near = ix.nearest([vectors[q]], 5)[0]
        assert near[1].tolist() == want[:5]
        # scores from a full scan's neighbours
        votes = []
        cosines = sorted(((c, k) for c, k in cosine if c > 0), reverse=True)
        for power in toxicity.POWERS:
            for size in toxicity.SIZES:
                w = [(c**power, ix.labels[-k]) for c, k in cosines[:size]]
                rate = (sum(a * y for a, y in w) + toxicity.PRIOR_WEIGHT * model.base) / (sum(a for a, _ in w) + toxicity.PRIOR_WEIGHT)
                rate = min(max(rate, 1e-4), 1 - 1e-4)
                votes.append(math.log(rate / (1 - rate)))
        z = sum(a * b for a, b in zip(model.weights, [*votes, 1.0], strict=True))
        assert abs(got[q].score - 1 / (1 + math.exp(-z))) < 1e-6
    empty, found = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scored(found, empty).collect()} == {0.0}


@pytest.mark.parametrize("n", [0, 6])
def test_toxicity_edges(spark, n):
    """Empty tables, clashing names, several texts and labels of one id, and a very long text."""
    rows = [(1, "good day", 1.0, True), (1, "bad day", 1.0, True), (1, "bad day", 1.0, True), (None, "bad", 0.5, None), (3, "idiot " * 200_000, None, False), (4, None, None, None)][:n]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, toxic int")
    model, found = toxicity.fit(docs, labels)
    assert sorted((r.doc_id or 0) for r in toxicity.scored(found, model).collect()) == sorted((r[0] or 0) for r in rows)
    if n:
        taken = {r.doc_id: (r.text, r.toxic) for r in toxicity.examples_of(docs, labels).collect()}
        assert taken.get(1, ("bad day", 1)) == ("bad day", 1)


def test_toxicity_vectors_hold_every_term_of_the_examples(spark):
    from collections import Counter
    from math import log

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    rows = [(i, _prose(rng, rng.choice([5, 40]), vocab) + (" villain" if i == 4 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, "villain unseenword")], "doc_id long, text string")
    model, found = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    counts = {i: Counter(t.split()) for i, t in rows}
    ids = [i for i, _ in rows if not _held(i)]
    df = Counter(t for c in counts.values() for t in c) + Counter(["villain", "unseenword"])
    vocabulary = {t for i in ids for t in counts[i]}
    assert set(model.index.number) == vocabulary and len(vocabulary) > 256 and not _held(4)

    def unit(c):
        v = {t: (1 + log(n)) * log(302 / (1 + df[t])) for t, n in c.items() if t in vocabulary}
        norm = sum(w * w for w in v.values()) ** 0.5
        return {t: w / norm for t, w in v.items()}

    vectors = {i: unit(c) for i, c in counts.items()}
    got = {r.doc_id: r.evidence for r in toxicity.scored(found, model).collect()}
    for i, v in vectors.items():
        cosine = [(-round(sum(w * vectors[d].get(t, 0) for t, w in v.items()), 9), d) for d in ids]
        assert got[i] == [d for c, d in sorted(cosine)[: toxicity.NEIGHBOURS] if c < 0]
    assert got[900] == [4]


def test_logistic():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 10)
    y = np.array([0, 0, 1, 1] * 9 + [0, 1, 0, 1], float)
    w = toxicity.logistic(x, y, 1e-6)
    p = 1 / (1 + np.exp(-(x[:, 0] * w[0] + w[1])))
    assert w[0] > 0 and abs((y - p).sum()) < 1e-4 and abs(((y - p) * x[:, 0]).sum()) < 1e-4


def _lines(rows):
    """script, figure -> slope, base, spread, straight from the definition."""
    lower = lambda xs: sorted(xs)[(len(xs) - 1) // 2]
    out = {}
    for script in {r.script for r in rows}:
        own = [r for r in rows if r.script == script]
        for figure, (count, _, _, prior) in quality.LEARNT.items():
            x, y = np.array([math.log2(max(1, r[count])) for r in own]), np.array([r[figure] for r in own])
            var = ((x - x.mean()) ** 2).mean()
            slope = ((x - x.mean()) * (y - y.mean())).mean() / var if var > 0 else 0.0
            base = y.mean() - slope * x.mean()
            off = [math.floor((v - base - slope * u) / quality.STEP + 0.5) for u, v in zip(x, y, strict=True)]
            mid = lower(off)
            mad = 1.4826 * max(1, lower([abs(o - mid) for o in off])) * quality.STEP
            out[script, figure] = slope, base + mid * quality.STEP, (len(own) * mad + quality.PRIOR * prior) / (len(own) + quality.PRIOR)
    return out


def test_quality_learns_bands_of_all_figures(spark):
    """Texts whose tokens are unlike those of their script are rejected, each for its own figure, by lines that brute force gives too."""
    rng = random.Random(6)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    vocab = [word("etaoinshrdlu", rng.choice([3, 5, 8])) for _ in range(800)]
    rows = [(i, _prose(rng, rng.randrange(58, 400), vocab)) for i in range(300)] + [(400 + i, _prose(rng, 70, [word("αβγδεηιου", 5) for _ in range(90)])) for i in range(4)]
    monotone = [(900 + i, _prose(rng, 120, vocab[40 * i : 40 * i + 30]) + " end") for i in range(3)]
    consonants = [(910 + i, _prose(rng, 100, [word("qxzjvkw", 7) for _ in range(100)])) for i in range(3)]
    rare = [(920 + i, " ".join(w[:1] + "\u0237\u0242" + w[1:] for w in _prose(rng, 100, vocab).split())) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows + monotone + consonants + rare], "doc_id long, text string, m string, script int")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    found = _lines([r for r in got.values() if not r.base_failed])
    reason = {"chars": "out_chars", "share": "out_bytes", "entropy": "out_entropy"}
    for i, r in got.items():
        want = {name: False for name in reason.values()}
        for figure, (count, least, most, _) in quality.LEARNT.items():
            if not r.base_failed:
                slope, base, spread = found[r.script, figure]
                z = (r[figure] - base - slope * math.log2(max(1, r[count]))) / spread
                want[next(v for k, v in reason.items() if k in figure)] |= not least <= z <= most
        assert {name: r[name] for name in want} == want, i
    assert all(got[i].out_entropy for i, _ in monotone) and all(got[i].out_chars for i, _ in consonants) and all(got[i].out_bytes for i, _ in rare)
    assert not any(got[i].kept for i, _ in monotone + consonants + rare) and all(got[i].kept for i, _ in rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("text, script", [("αβγ abc δε", "greek"), ("שלום", "hebrew"), ("こんにちは", "kana"), ("漢字漢字 abc", "han"), ("12 !?", "latin"), ("ქართული", "other"), ("ab вг", "latin")])
def test_scripts(text, script):
    assert quality.script_of(text) == script and quality.BANDS[script].most_chars > 1


def test_tokens_of_words_met_together_equal_those_of_words_alone(monkeypatch):
    rng = random.Random(8)
    parts = ["it's", "'S", "\u00a0", "\u2003x", "a\u0085b", "\x1c", "Straße", "漢字", "🙂", "12", "--", "'re", "x" * 300, "\u200b", "don't", "l'été"]
    texts = [["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(40))] for _ in range(60)]
    met = quality._Words(quality.vocabulary())
    calls = []
    for i in range(0, len(texts), 20):
        if i == 40:
            monkeypatch.setattr(quality, "REMEMBERED", 10)  # starts anew
        met.meet(texts[i : i + 20])
        calls.append(len(met.number))
        for words in texts[i : i + 20]:
            at = met.numbers(words)
            assert met.pieces.joined(at).tolist() == [x for w in words for x in met.model.encode(w)]
            assert met.bytes.joined(at).tolist() == [x for w in words for x in met.byte_model.encode_ordinary(f" {w}")]
            assert quality._repeated(at) == quality.repeated_words(words)
    assert calls[0] < calls[1] > calls[2] and met.pieces.n == met.bytes.n == len(met.number)


def test_quality_of_a_very_long_text(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(3000)]
    got = quality.judged(spark.createDataFrame([(1, _prose(rng, 200_000, vocab)), (2, "x" * 300_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.base_failed) for r in got} == {1: (200_000, False), 2: (1, True)}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_unused_columns_do_not_clash(spark, n):
    docs = spark.createDataFrame([(i, "a b", "x", "y") for i in range(n)], "doc_id long, text string, row string, m string")
    assert quality.keep_good(docs).count() == 0 and bpe.digests(docs).count() == n
