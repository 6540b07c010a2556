"""Texts cut into citable chunks of whole lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE_END = re.compile(r"\r\n|[\r\n]")
FRAME = 2
#: Texts that are Python objects at a time, however many a batch has.
AT_ONCE = 128
CHUNK = "doc_id long, ordinal int, start_line int, end_line int, body string, cut boolean"


def count_words(text: str) -> int:
    return len(text.split())


def windows(lines: list[str], most_lines: int, budget: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, bool]]:
    """(first, end, cut) of windows of whole lines, end exclusive.

    Blank edges are trimmed, a window shrinks from its end until it fits the
    budget, and the next begins where it ended. One line that is too long is a
    window of its own and marked. Every line that is not blank is in one window.
    """
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        end = min(at + most_lines, len(lines))
        while end > at + 1 and (not lines[end - 1].strip() or count("\n".join(lines[at:end])) > budget):
            end -= 1
        yield at, end, end == at + 1 and count(lines[at]) > budget
        at = end


def chunked(docs: DataFrame, most_lines: int = 40, max_tokens: int = 256, count: Callable[[str], int] = count_words) -> DataFrame:
    """doc_id, ordinal, start_line, end_line, body, cut of every whole text; lines count from 1 and ends are included.

    Each document is cut on its own, so nothing is shuffled. Null and blank texts have no chunk.
    """
    if max_tokens <= FRAME or most_lines < 1:
        raise ValueError("no room for text")

    arrow = pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("body", pa.string()), ("cut", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in b.slice(i, AT_ONCE).columns), strict=True):
                    lines = _LINE_END.split(text or "")
                    rows += [(doc_id, n, a + 1, e, "\n".join(lines[a:e]), cut) for n, (a, e, cut) in enumerate(windows(lines, most_lines, max_tokens - FRAME, count))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(arrow), arrow.types, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNK)


#: The share of the budget that a header takes at most.
HEADER_SHARE = 0.25
SECTION = "doc_id long, ordinal int, start_line int, end_line int, header string, body string, cut boolean"


@dataclass(frozen=True)
class Block:
    """Lines start to end (from 1, both included) under a trail of headings; blocks of one unit belong together."""

    start: int
    end: int
    trail: tuple[str, ...] = ()
    unit: int = 0


def header_of(title: str, trail: Sequence[str], limit: int, count: Callable[[str], int]) -> str:
    """Title and headings in a row, as many as `limit` tokens hold: headings between the title and the last go first, then the title, then all. Equal neighbours are named once."""
    last = trail[-1:]
    kept = ([title, *trail], [title, *last], [*last], [])

    def said(parts: Sequence[str]) -> str:
        full = [p for p in parts if p]
        return " > ".join(p for p, before in zip(full, [None, *full], strict=False) if p != before)

    return next(x for x in map(said, kept) if not x or count(x) <= limit)


def outlined(lines: list[str], blocks: Sequence[Block], title: str, budget: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, header, cut) of chunks that follow an outline.

    A unit stays whole if it fits the budget beside its header, else each of
    its blocks does, else the block's paragraphs are put together greedily and
    those too long are taken line by line. Chunks begin and end with lines that
    are not blank, and every such line of the blocks is in exactly one. A
    single line that does not fit is a chunk, marked cut.
    """
    below = list(accumulate((count(x) for x in lines), initial=0))
    full = [bool(x.strip()) for x in lines]

    def bare(start: int, end: int) -> list[int]:
        return [n for n in range(start, end + 1) if full[n - 1]]

    size = lambda a, b: below[b] - below[a - 1]

    def headed(block: Block) -> tuple[str, int]:
        """A block's header and the tokens that are left beside it."""
        head = header_of(title, block.trail, int(budget * HEADER_SHARE), count)
        return head, budget - count(head)

    for _, unit in groupby(blocks, key=lambda b: b.unit):
        together = list(unit)
        head, room = headed(together[0])
        own = bare(together[0].start, together[-1].end)
        if len(together) > 1 and own and size(own[0], own[-1]) <= room:
            yield own[0], own[-1], head, False
            continue
        for block in together:
            head, room = headed(block)
            pieces: list[tuple[int, int]] = []
            for _, run in groupby(bare(block.start, block.end), key=lambda n, first=iter(range(1 << 60)): n - next(first)):
                paragraph = list(run)
                whole = (paragraph[0], paragraph[-1])
                pieces += [whole] if size(*whole) <= room else [(n, n) for n in paragraph]
            at = 0
            while at < len(pieces):
                last = at
                while last + 1 < len(pieces) and size(pieces[at][0], pieces[last + 1][1]) <= room:
                    last += 1
                yield pieces[at][0], pieces[last][1], head, size(pieces[at][0], pieces[last][1]) > room
                at = last + 1


def sectioned(docs: DataFrame, outline: Callable[[str], Sequence[Block]], max_tokens: int = 256, count: Callable[[str], int] = count_words) -> DataFrame:
    """doc_id, ordinal, start_line, end_line, header, body, cut of every whole text (doc_id, text, title), cut by its outline.

    Each document is cut on its own, so nothing is shuffled. Null and blank texts have no chunk.
    """
    if max_tokens <= FRAME:
        raise ValueError("no room for text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, title in zip(b["doc_id"], b["text"], b["title"], strict=True):
                lines = _LINE_END.split(text or "")
                found = outlined(lines, outline(text or ""), title or "", max_tokens - FRAME, count)
                rows += [(doc_id, n, a, e, head, "\n".join(lines[a - 1 : e]), cut) for n, (a, e, head, cut) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "start_line", "end_line", "header", "body", "cut"])

    return docs.select("doc_id", "text", "title").mapInPandas(run, SECTION)


def owners(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each line (doc_id, line) with the ordinal of the chunk that holds it; chunks of a document never overlap. Lines between chunks have none.

    An equal join on the document, with the line's place as residue: chunks come as one array of their document, so no pair of line and foreign chunk is made.
    """
    spans = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "ordinal"))).alias("_spans"))
    own = F.filter("_spans", lambda s: (s["start_line"] <= F.col("line")) & (F.col("line") <= s["end_line"]))
    return lines.join(spans, "doc_id", "left").select(*lines.columns, F.get(own, F.lit(0))["ordinal"].alias("ordinal"))
