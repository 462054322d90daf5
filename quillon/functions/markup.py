"""Markdown structure, read line by line in Python; used in Arrow batches by the operators.

A subset of CommonMark: fences, indented code, ATX and setext headings, inline, reference and image links, code spans, HTML
anchors and comments.  Nested block quotes and lists are read as their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_ATX = re.compile(r"\s*(#{1,6})(?:[ \t](.*))?$")
_BULLET = re.compile(r"\s*[-*+] +\*\*(.+?)\*\*")
_RUN = re.compile(r"`+")
_INLINE = re.compile(r"!?\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\(\s*(<[^>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_REF = re.compile(r"!?\[((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\])?(?!\()")
_DEFINITION = re.compile(r" {0,3}\[([^\]]+)\]:\s*(<[^>]*>|\S+)")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ANCHOR = re.compile(r"<[A-Za-z][^>]*?\s(?:id|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


@dataclass
class Line:
    number: int  # from 1, in the whole file
    text: str
    body: bool
    fenced: bool = False
    fence: bool = False
    level: int = 0
    title: str | None = None
    bullet: str | None = None


def fence_of(line: str, indent: int = 0) -> tuple[str, int] | None:
    """(character, length) of the fence that begins a line, after at most ``indent`` spaces."""
    s = line.lstrip(" ")
    if len(line) - len(s) > indent or not s or s[0] not in "`~":
        return None
    n = len(s) - len(s.lstrip(s[0]))
    return (s[0], n) if n >= 3 else None


def heading(line: str) -> tuple[int, str] | None:
    m = _ATX.match(line)
    return (len(m[1]), (m[2] or "").strip().rstrip("#").strip()) if m else None


def each_line(text: str, body_from: int = 1) -> Iterator[Line]:
    """Every line with its place in the document, one at a time; ``body_from`` is the first line of the body."""
    opened: tuple[str, int] | None = None
    for n, raw in enumerate(text.split("\n"), 1):
        row = Line(n, raw.rstrip("\r"), n >= body_from)
        if row.body:
            f = fence_of(row.text)
            if opened:
                row.fenced = True
                if f and f[0] == opened[0] and f[1] >= opened[1]:
                    row.fence, opened = True, None
            elif f:
                row.fence, row.fenced, opened = True, True, f
            elif h := heading(row.text):
                row.level, row.title = h
            elif b := _BULLET.match(row.text):
                row.bullet = b[1].strip()
        yield row


def lines(text: str, body_from: int = 1) -> list[Line]:
    return list(each_line(text, body_from))


def code_ranges(line: str) -> list[tuple[int, int]]:
    """Ranges of inline code: a run of backticks up to the next run of the same length."""
    runs = [(m.start(), m.end()) for m in _RUN.finditer(line)]
    out, i = [], 0
    while i < len(runs):
        size = runs[i][1] - runs[i][0]
        j = next((k for k in range(i + 1, len(runs)) if runs[k][1] - runs[k][0] == size), None)
        if j is None:
            i += 1
        else:
            out.append((runs[i][0], runs[j][1]))
            i = j + 1
    return out


def masked(line: str) -> str:
    """The line with inline code blanked out, positions kept."""
    for a, b in code_ranges(line):
        line = line[:a] + " " * (b - a) + line[b:]
    return line


def prose(text: str, body_from: int = 1) -> list[tuple[int, str]]:
    """(line number, text) of body lines outside fences and indented code, inline code blanked out."""
    out, opened, blank = [], None, True
    for n, raw in enumerate(text.split("\n"), 1):
        if n < body_from:
            continue
        line = raw.rstrip("\r")
        f = fence_of(line, 3)
        if opened:
            if f and f[0] == opened[0] and f[1] >= opened[1] and not line.strip().strip(f[0]):
                opened = None
            blank = False
            continue
        if f:
            opened = f
            continue
        if blank and (line.startswith("    ") or line.startswith("\t")) and line.strip():
            continue
        blank = not line.strip()
        out.append((n, masked(line)))
    return out


def links(text: str, body_from: int = 1) -> list[tuple[int, str]]:
    """(line number, destination) of every inline, reference and image link."""
    rows = prose(text, body_from)
    defined = {m[1].strip().casefold(): m[2].strip("<>") for _, line in rows if (m := _DEFINITION.match(line))}
    out = []
    for n, line in rows:
        if _DEFINITION.match(line):
            continue
        for m in _INLINE.finditer(line):
            out.append((n, m[2].strip("<>")))
            for inner in _INLINE.finditer(m[1]):
                out.append((n, inner[2].strip("<>")))
        for m in _REF.finditer(_INLINE.sub(lambda m: " " * len(m[0]), line)):
            label = (m[2] or m[1]).strip().casefold()
            if label in defined:
                out.append((n, defined[label]))
    return out


def slug(title: str) -> str:
    return "".join("-" if c == " " else c for c in title.lower() if c.isalnum() or c in "_- ")


def plain(title: str) -> str:
    """A heading's text without emphasis, code marks and link targets."""
    title = _INLINE.sub(lambda m: m[1], title)
    return re.sub(r"[*`]", "", title)


def heading_slugs(text: str, body_from: int = 1) -> list[str]:
    """Slugs of all headings in order, repeats numbered ``-1`` on, then HTML anchors as written and as slugs."""
    seen: dict[str, int] = {}
    out: list[str] = []
    before: str | None = None

    def put(title: str) -> None:
        base = slug(plain(title))
        if not base:
            return
        n = seen.get(base, 0)
        seen[base] = n + 1
        out.append(f"{base}-{n}" if n else base)

    rows = prose(text, body_from)
    raw = text.split("\n")
    for n, line in rows:
        line = raw[n - 1].rstrip("\r")
        if h := heading(line):
            put(h[1])
            before = None
        elif before is not None and re.fullmatch(r" {0,3}(=+|-+)\s*", line):
            put(before)
            before = None
        else:
            before = line.strip() or None
    for m in _ANCHOR.finditer(_COMMENT.sub("", "\n".join(line for _, line in rows))):
        name = next(x for x in m.groups() if x is not None)
        out += [name, slug(name)]
    return list(dict.fromkeys(out))


_EXT = r"\.[a-zA-Z][0-9a-zA-Z]{0,7}"
_TAIL = r"[\w/.-]*"
CITATION = re.compile("|".join((rf"(?:\.\./)+{_TAIL}{_EXT}", rf"/\w{_TAIL}{_EXT}", rf"\b\w{_TAIL}{_EXT}")).join(("(", ")")) + r":(\d{1,6})(?:-(\d{1,6}))?", re.A)


def citations(text: str, body_from: int = 1) -> list[tuple[int, str, int, int | None]]:
    """(line number, path, first line, last line) of ``path.ext:n`` or ``path.ext:n-m``; what follows ``/`` or ``:`` is a URL's end."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if n < body_from:
            continue
        for m in CITATION.finditer(line):
            if m.start() and line[m.start() - 1] in "/:":
                continue
            out.append((n, m[1], int(m[2]), int(m[3]) if m[3] else None))
    return out


def bold_spans(text: str, body_from: int = 1) -> list[tuple[int, str]]:
    """(line number, trimmed content) of ``**…**`` in the body: 1 to 60 bytes, on one line; other pairs are used up without a span."""
    pieces = "\n".join(text.split("\n")[body_from - 1 :]).split("**")
    out, line = [], body_from
    for i, x in enumerate(pieces[:-1]):
        if i % 2 and x and "\n" not in x and len(x.encode("utf-8", "surrogatepass")) <= 60:
            out.append((line, x.strip()))
        line += x.count("\n")
    return out
