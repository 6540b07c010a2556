"""Markdown files: title, sections and links."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import unquote

from ..functions.text import LINE_END
from ..operators.chunking import Block

#: What a line is, besides a heading, which is its level.
PROSE, META, CODE = 0, -1, -2
#: Keys of front matter whose links relate the whole note.
RELATED = ("related", "patterns")
_LINES = re.compile(LINE_END)
_BETWEEN_TICKS = re.compile(r"(?<!`)(`+)(?!`)(?:.*?[^`])\1(?!`)")
_WIKI = re.compile(r"(!?)\[\[([^\[\]|#]+)(?:#([^\[\]|]*))?(?:\|[^\[\]]*)?\]\]")
_LABEL = re.compile(r"(!?)\[[^\[\]]*\]\(")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


class Link(NamedTuple):
    line: int
    kind: str
    target: str
    anchor: str | None


class Note(NamedTuple):
    title: str
    blocks: list[Block]
    links: list[Link]


def _indented(line: str) -> str | None:
    """The line without its indent, if that is no code."""
    bare = line.lstrip(" ")
    return bare if len(line) - len(bare) <= 3 else None


def _run(text: str, marks: str) -> int:
    """How often the first character of text stands there in a row, if it is one of marks."""
    return len(text) - len(text.lstrip(text[0])) if text and text[0] in marks else 0


def heading(line: str) -> tuple[int, str] | None:
    """Level and text of a heading written with #."""
    bare = _indented(line) or ""
    level = _run(bare, "#")
    said = bare[level:]
    if not 1 <= level <= 6 or said[:1] not in ("", " ", "\t"):
        return None
    said = said.strip(" \t")
    open_ = said.rstrip("#")
    return level, open_.rstrip(" \t") if open_.strip(" \t") and open_[-1] in " \t" else said


def fence(line: str) -> tuple[str, str] | None:
    """The marks that open or close a block of code, and what stands behind them."""
    bare = _indented(line) or ""
    size = _run(bare, "`~")
    return (bare[:size], bare[size:].strip(" \t")) if size >= 3 else None


def key_of(line: str) -> tuple[str, str] | None:
    """Key and value of a line of front matter."""
    name, colon, value = line.partition(":")
    name = name.rstrip(" \t")
    fits = colon and (name[:1].isalpha() and name[:1].isascii() or name[:1] == "_") and all(c.isalnum() or c in "_ .-" for c in name)
    return (name, value.strip(" \t")) if fits and value[:1] in ("", " ", "\t") else None


def front_matter(lines: Sequence[str]) -> int:
    """Lines of front matter: it opens with ---, has a key, and closes with --- or three dots."""
    if lines[0].rstrip() != "---":
        return 0
    size = next((n for n, line in enumerate(lines[1:], 2) if line.rstrip() in ("---", "...")), 0)
    return size if any(map(key_of, lines[1 : max(1, size - 1)])) else 0


def roles(lines: Sequence[str]) -> list[int]:
    """For each line its heading's level, or PROSE, META or CODE."""
    out = [META] * front_matter(lines)
    opened = ""
    for line in lines[len(out) :]:
        marks = fence(line)
        if opened:
            out.append(CODE)
            if marks and marks[0].startswith(opened) and not marks[1]:
                opened = ""
        elif marks and not (marks[0][0] == "`" and "`" in marks[1]):
            out.append(CODE)
            opened = marks[0]
        else:
            found = heading(line)
            out.append(found[0] if found else PROSE)
    return out


def sections(lines: Sequence[str], kinds: Sequence[int]) -> list[Block]:
    """Front matter, the text before the first heading, and a block under each heading with the headings over it.

    A heading with nothing under it is part of the section that follows; at
    the end, of the one before.
    """
    size, front = len(lines), sum(k == META for k in kinds)
    heads = [n for n, k in enumerate(kinds) if k > 0]
    trail: list[tuple[int, str]] = []
    parts: list[tuple[int, int, tuple[str, ...]]] = []
    if front:
        parts.append((0, front, ()))
    if front < (heads[0] if heads else size):
        parts.append((front, heads[0] if heads else size, ()))
    waiting = None
    for n, end in zip(heads, [*heads[1:], size][: len(heads)], strict=True):
        level, said = heading(lines[n])
        trail = [x for x in trail if x[0] < level] + [(level, said)]
        begin = n if waiting is None else waiting
        if any(x.strip() for x in lines[n + 1 : end]):
            parts.append((begin, end, tuple(x for _, x in trail)))
            waiting = None
        elif end < size:
            waiting = begin
        elif parts and parts[-1][0] >= front:
            parts[-1] = parts[-1][0], end, parts[-1][2]
        else:
            parts.append((begin, end, tuple(x for _, x in trail)))
    return [Block(a + 1, b, t, n) for n, (a, b, t) in enumerate(parts)]


def outline(text: str) -> list[Block]:
    """sections() of a whole text, each a unit."""
    lines = _LINES.split(text)
    return sections(lines, roles(lines))


def note_key(target: str) -> str:
    return target.strip().casefold().removesuffix(".md")


def _place(rest: str) -> str | None:
    """The target that a link's parentheses begin with, if they close after it and a title at most."""
    if rest.startswith("<"):
        target, closed, rest = rest[1:].partition(">")
        if not closed:
            return None
    else:
        depth = at = 0
        while at < len(rest) and not rest[at].isspace() and not (rest[at] == ")" and not depth):
            depth += {"(": 1, ")": -1}.get(rest[at], 0)
            at += 1
        target, rest = rest[:at], rest[at:]
    rest = rest.lstrip(" \t")
    if rest[:1] in ('"', "'"):
        rest = rest[1:].partition(rest[0])[2].lstrip(" \t")
    return target if target and rest.startswith(")") else None


def resolved(target: str, path: str) -> tuple[str, str | None] | None:
    """The path from the root that a relative target in file `path` means, and its anchor; None for URLs, bare anchors and what climbs above the root."""
    place, _, anchor = target.partition("#")
    place = place.partition("?")[0]
    if not place or _SCHEME.match(target):
        return None
    whole = posixpath.normpath(posixpath.join("/" if place.startswith("/") else posixpath.dirname(path), unquote(place.lstrip("/"))))
    return None if whole.startswith("..") or whole in (".", "/") else (whole.lstrip("/"), unquote(anchor) or None)


def _links(n: int, line: str, path: str, kind: str) -> Iterator[tuple[int, Link]]:
    """(place, link) of the links of a line; images and embedded attachments are none."""
    line = line.replace("\\|", "|")  # in a table cell the bar before a label is escaped
    for m in _WIKI.finditer(line):
        key = note_key(m[2])
        attached = m[1] and "." in posixpath.basename(m[2].strip()) and not m[2].strip().casefold().endswith(".md")
        if key and not attached:
            yield m.start(), Link(n, kind, key, (m[3] or "").strip() or None)
    for m in _LABEL.finditer(line):
        found = resolved(_place(line[m.end() :]) or "", path)
        if found and not m[1]:
            yield m.start(), Link(n, "markdown", *found)


def read(path: str, text: str) -> Note:
    """A note's title (that of its front matter, else its first heading of level one, else its name), blocks and links."""
    lines = _LINES.split(text)
    kinds = roles(lines)
    title = first = key = ""
    links: list[Link] = []
    for n, (line, kind) in enumerate(zip(lines, kinds, strict=True), 1):
        if kind == META:
            held = key_of(line)
            key = held[0].casefold() if held else key
            if held and key == "title" and held[1]:
                title = held[1][1:-1] if len(held[1]) > 1 and held[1][0] == held[1][-1] in ("'", '"') else held[1]
        elif kind == 1:
            first = first or heading(line)[1]
        if kind != CODE:
            shown = line if kind == META else _BETWEEN_TICKS.sub(" ", line)
            links += [x for _, x in sorted(_links(n, shown, path, "related" if kind == META and key in RELATED else "wikilink"), key=lambda x: x[0])]
    name = posixpath.basename(path)
    return Note(title or first or name.removesuffix(posixpath.splitext(name)[1]), sections(lines, kinds), links)
