"""Markdown and Python files as blocks and links, and server-sent events."""

from __future__ import annotations

import ast
import codecs
import io
import json
import sys
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import Block
from . import markdown

LINK = "path string, line int, kind string, target string, anchor string"


def markdown_links(path: str, text: str) -> Iterator[tuple[int, str, str, str | None]]:
    """(line, kind, target, anchor): wikilinks, those of related notes in front matter, and relative links resolved against the file's folder."""
    yield from markdown.read(path, text).links


def python_imports(path: str, text: str) -> Iterator[tuple[int, str, str, str | None]]:
    """Imports as links to modules, relative ones resolved; bare names of the standard library and files that do not parse give none."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    package = path.removesuffix(".py").removesuffix("/__init__").split("/")[: None if path.endswith("__init__.py") else -1]
    for node in ast.walk(module):
        if isinstance(node, ast.Import):
            names = [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            if node.level > len(package) + 1:
                continue
            base = package[: len(package) - node.level + 1] if node.level else []
            stem = ".".join([*base, *([node.module] if node.module else [])])
            names = [stem] if node.module else [f"{stem}.{a.name}" if stem else a.name for a in node.names]
        else:
            continue
        yield from ((node.lineno, "import", x, None) for x in names if x.partition(".")[0] not in sys.stdlib_module_names)


def python_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, name) of top-level definitions and the lines between; a file that does not parse is one block."""
    total = text.count("\n") + 1
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        yield 1, total, ""
        return
    at = 1
    for node in body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
            if first > at:
                yield at, first - 1, ""
            yield first, node.end_lineno, node.name
            at = node.end_lineno + 1
    if at <= total:
        yield at, total, ""


def python_outline(text: str) -> list[Block]:
    """Top-level definitions as blocks; a class is a unit of its head and its methods. Lines between definitions are blocks without a name; a file that does not parse is one block."""
    total = text.count("\n") + 1
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return [Block(1, total)]
    defines = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    first = lambda node: min([node.lineno, *[d.lineno for d in node.decorator_list]])
    out: list[Block] = []
    at = 1
    for unit, node in enumerate([n for n in body if isinstance(n, defines)], 1):
        if first(node) > at:
            out.append(Block(at, first(node) - 1, (), -unit))
        inner = [n for n in node.body if isinstance(n, defines)] if isinstance(node, ast.ClassDef) else []
        starts = [first(node), *[first(n) for n in inner]]
        trails = [(node.name,), *[(node.name, n.name) for n in inner]]
        ends = [s - 1 for s in starts[1:]] + [node.end_lineno]
        out += [Block(s, e, t, unit) for s, e, t in zip(starts, ends, trails, strict=True) if s <= e]
        at = node.end_lineno + 1
    return out + [Block(at, total)] * (at <= total)


def links(files: DataFrame) -> DataFrame:
    """path, line, kind, target, anchor of the links in files (path, kind, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *x) for p, k, t in zip(b["path"], b["kind"], b["text"], strict=True) for x in (markdown_links if k == "markdown" else python_imports)(p, t)]
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "target", "anchor"])

    return files.where(F.col("kind").isin("markdown", "python") & F.col("text").isNotNull()).select("path", "kind", "text").mapInPandas(run, LINK)


class EventParser:
    """Server-sent events (kind, data) from text or UTF-8 bytes that come in any pieces; an unfinished tail is dropped, an event over the cap fails.

    The fields of an event are gathered by name and read when a blank line ends
    it. A byte order mark at the start is skipped. last_id is the last id
    without a NUL that was sent, retry the last whole number of milliseconds,
    else None. A carriage return at the end of a piece is a line end once more
    comes, or at close().
    """

    def __init__(self, most: int = 8 * 1024**2):
        self.most = most
        self.last_id, self.retry = "", None
        self._text = codecs.getincrementaldecoder("utf-8")("replace")
        self._ends = io.IncrementalNewlineDecoder(None, translate=True)
        self._tail: list[str] = []
        self._fields: dict[str, list[str]] = {}
        self._begun, self._size = False, 0

    def feed(self, piece: str | bytes) -> Iterator[tuple[str, str]]:
        yield from self._read(self._ends.decode(self._text.decode(piece) if isinstance(piece, bytes) else piece))

    def close(self) -> Iterator[tuple[str, str]]:
        yield from self._read(self._ends.decode("", final=True))

    def _read(self, text: str) -> Iterator[tuple[str, str]]:
        if text and not self._begun:
            self._begun, text = True, text.removeprefix("\ufeff")
        self._tail.append(text)
        self._size += len(text)
        if "\n" in text:
            *lines, rest = "".join(self._tail).split("\n")
            self._tail = [rest]
            for line in lines:
                if line:
                    self._gather(line)
                elif self._fields:
                    yield from self._event()
            self._size = len(rest) + sum(map(len, self._fields.get("data", ())))
        if self._size > self.most:
            raise ValueError("an event is too large")

    def _gather(self, line: str) -> None:
        name, _, value = line.partition(":")
        if name:
            self._fields.setdefault(name, []).append(value.removeprefix(" "))
        if name == "id":
            self.last_id = next((x for x in reversed(self._fields["id"]) if "\0" not in x), self.last_id)
        if name == "retry":
            self.retry = next((int(x) for x in reversed(self._fields["retry"]) if x.isascii() and x.isdigit()), self.retry)

    def _event(self) -> Iterator[tuple[str, str]]:
        fields, self._fields = self._fields, {}
        if "data" in fields:
            yield fields.get("event", [""])[-1] or "message", "\n".join(fields["data"])


_ANSWER = "stream string, text string, finish string, total_tokens long, tool_calls array<struct<index:int,id:string,name:string,arguments:string>>"


def answers(chunks: DataFrame) -> DataFrame:
    """stream, text, finish, total_tokens, tool_calls from pieces (stream, at, piece) of streamed answers: deltas joined in order; the last finish and usage count.

    Fragments of a tool call have its index: the first id and name are its own,
    arguments are joined. A stream's pieces are one answer, so they are folded
    in one group.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        parser, text, finish, used = EventParser(), [], None, None
        calls: dict[int, dict] = {}
        pieces = rows.sort_values("at")["piece"]
        for _, data in chain(chain.from_iterable(map(parser.feed, pieces)), parser.close()):
            if data == "[DONE]":
                continue
            x = json.loads(data)
            for choice in x.get("choices", []):
                delta = choice.get("delta", {})
                text.append(delta.get("content") or "")
                finish = choice.get("finish_reason") or finish
                for part in delta.get("tool_calls") or []:
                    call = calls.setdefault(part.get("index", 0), {"index": part.get("index", 0), "id": None, "name": None, "arguments": ""})
                    said = part.get("function") or {}
                    call["id"], call["name"] = call["id"] or part.get("id"), call["name"] or said.get("name")
                    call["arguments"] += said.get("arguments") or ""
            used = (x.get("usage") or {}).get("total_tokens", used)
        own = [calls[i] for i in sorted(calls)]
        return pd.DataFrame({"stream": [rows["stream"].iloc[0]], "text": ["".join(text)], "finish": [finish], "total_tokens": pd.array([used], dtype="Int64"), "tool_calls": [own]})

    return chunks.groupBy("stream").applyInPandas(fold, _ANSWER)
