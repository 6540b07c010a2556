"""BPE encoding by backtracking, and decoding by an offset table.

A pre-token is encoded without running merges: an Aho-Corasick automaton over
the vocabulary gives every token that starts at each place; the encoder walks
left to right with the longest one, keeps it only if it may follow the token
before (a pair is compatible if no merge would have crossed the border
earlier), tries the next shorter one otherwise, and steps back when none fits.
A bit for each position that proved a dead end keeps the walk linear. The
result is the merges' own. Decoding cuts tokens out of one flat string by a
table of offsets.

The vocabulary is a `tokenizers` JSON file; its path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, table

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
#: One character that stands for the end of a word inside the automaton; byte-level text has none of it.
_STOP = "\x00"
#: Pre-tokens that a task remembers; when there are so many, it starts anew.
REMEMBERED = 300_000


class BacktrackingBpe:
    """Encoder and decoder of one vocabulary with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # rank: base tokens first, then merges in their order; pairs and splits are in ranks
        born: dict[str, int] = {}
        for t in vocab.keys() - {a + b for a, b in merges}:
            born[t] = len(born)
        base = len(born)
        self.split: list[tuple[int, int]] = [(i, i) for i in range(base)]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            r = len(self.split)
            self.pair[born[a], born[b]] = r
            self.split.append((born[a], born[b]))
            born.setdefault(a + b, r)
        self.ids = {r: vocab[t] for t, r in born.items()}
        # a letter at a word's end is one symbol with its end mark from the start, so the mark is no token of its own
        keys = {t.removesuffix(END) + _STOP if t.endswith(END) else t: r for t, r in born.items()}
        self.length = {r: len(key) for key, r in keys.items()}
        #: The next shorter token that starts a token.
        self.shorter = {r: next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), -1) for key, r in keys.items()}
        self.automaton = ahocorasick.Automaton()
        for key, r in keys.items():
            self.automaton.add_word(key, (len(key) - 1, r))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        by_id = sorted([(i, t) for t, i in vocab.items()] + [(i, t) for t, i in self.special.items()])
        self.flat = "".join(t for _, t in by_id)
        self.offsets, at = {}, 0
        for i, t in by_id:
            self.offsets[i] = (at, at + len(t))
            at += len(t)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side: no merge across their border would come before theirs."""
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        pair, split, limit, ok = self.pair, self.split, 1 << 60, True
        while True:
            if pair.get((left, right), limit) < limit:
                ok = False
                break
            if left > right:  # undo the later of the two merges
                limit, left = left, split[left][1]
                if left != limit:
                    continue
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    break
            else:
                limit, right = right + 1, split[right][0]
                if right + 1 != limit:
                    continue
                limit = left
                left = split[left][1]
                if left == limit:
                    break
        if len(self.fits) > 4 * REMEMBERED:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def word(self, letters: str) -> list[int]:
        """Ranks of one pre-token, given in byte-level letters."""
        text = letters + _STOP
        n = len(text)
        longest = [-1] * n
        for end, (size, r) in self.automaton.iter(text):  # by rising end, so the longest of a start comes last
            longest[end - size] = r
        length, shorter, fits, compatible = self.length, self.shorter, self.fits, self.compatible
        dead, out, at, last, r = set(), [], 0, -1, longest[0]
        while at < n:
            while r >= 0:
                end = at + length[r]
                if end not in dead and (last < 0 or (ok if (ok := fits.get((last, r))) is not None else compatible(last, r))):
                    break
                r = shorter[r]
            if r >= 0:
                out.append(r)
                at, last = end, r
                r = longest[at] if at < n else -1
            elif out:
                dead.add(at)
                r = out.pop()
                at -= length[r]
                r, last = shorter[r], out[-1] if out else -1
            else:
                raise ValueError("a symbol is not in the vocabulary")
        return out

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text in lower case; special tokens as ids."""
        if "<|" not in text and not _FAR.search(text):
            return _SPLIT.findall(text.lower())
        out: list[str | int] = []
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if self.special else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif _FAR.search(part):
                out += [p.translate(_FROM_LETTER).encode("latin-1").decode("utf-8", "surrogateescape") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
            else:
                out += _SPLIT.findall(part.lower())
        return out

    def piece(self, piece: str | int) -> list[int]:
        return [piece] if isinstance(piece, int) else [self.ids[r] for r in self.word(_byte_level(piece))]

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.pieces(text or "") for i in self.piece(p)]

    def decode(self, ids: list[int]) -> str:
        flat, offsets = self.flat, self.offsets
        return " ".join([flat[a:b] for a, b in map(offsets.__getitem__, ids)])


#: Letters, digits and white space below U+0180, where the pre-tokenizer's classes and lower case are the same in every Unicode version.
_NEAR = [chr(i) for i in range(0x180)]
_class = lambda kind: "".join(re.escape(c) for c in _NEAR if unicodedata.category(c)[0] == kind)
_LETTER, _DIGIT, _BLANK = _class("L"), _class("N"), "\\x09-\\x0d \\x85\\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_BLANK}{_LETTER}{_DIGIT}]+")
_FAR = re.compile("[^\\x00-\\u012f\\u0131-\\u017f]")


def _letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


_TO_LETTER = _letters()
_FROM_LETTER = {ord(c): b for b, c in _TO_LETTER.items()}


def _byte_level(piece: str) -> str:
    if piece.isascii() and piece.isprintable():
        return piece
    return piece.encode("utf-8", "surrogateescape").decode("latin-1").translate(_TO_LETTER)


@cache
def encoder(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every whole text; null texts count as empty.

    The rows are one to one with the input's; other columns are not read.
    """
    where = path or vocabulary()

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        bpe, memo = encoder(where), {}
        for r in each:
            ids: list[int] = []
            for p in bpe.pieces(r["text"] or ""):
                if (got := memo.get(p)) is None:
                    if len(memo) >= REMEMBERED:
                        memo.clear()
                    got = memo[p] = bpe.piece(p)
                ids += got
            yield r["doc_id"], ids, bpe.decode(ids)

    return mapped(docs.select("doc_id", "text"), "doc_id long, ids array<int>, decoded string", rows, 64)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, one row for each input row.

    Null and empty texts have no token and the digests of the empty string. A
    pre-token's ids and decoded form are remembered as text, so a document's
    digests are joins of those.
    """
    where = path or vocabulary()

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        bpe = encoder(where)
        memo: dict[str | int, tuple[int, str, str]] = {}
        for r in each:
            n, ids, said = 0, [], []
            for p in bpe.pieces(r["text"] or ""):
                got = memo.get(p)
                if got is None:
                    if len(memo) >= REMEMBERED:
                        memo.clear()
                    own = bpe.piece(p)
                    got = memo[p] = (len(own), " ".join(map(str, own)), bpe.decode(own))
                n += got[0]
                ids.append(got[1])
                said.append(got[2])
            yield r["doc_id"], n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(said).encode()).hexdigest()

    return mapped(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
