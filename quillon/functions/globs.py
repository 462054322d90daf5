"""Globs as regular expressions, in two dialects."""

from __future__ import annotations

import re


def _class(pattern: str, i: int) -> tuple[str, int]:
    j = i + 1
    if j < len(pattern) and pattern[j] in "!^":
        j += 1
    j = pattern.find("]", j + 1)
    if j < 0:
        raise ValueError(f"unclosed [ in glob {pattern!r}")
    body = pattern[i + 1 : j]
    if body[0] in "!^":
        body = "^" + body[1:]
    return "[" + body.replace("\\", "\\\\") + "]", j


def match_regex(pattern: str) -> str:
    """A glob over whole paths, whose ``*`` and ``?`` match slashes too."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 2
        elif c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            part, i = _class(pattern, i)
            out.append(part)
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def walk_regex(pattern: str) -> str:
    """A glob over directories: ``*`` and ``?`` stay within a component, ``**`` is any number of them."""
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    out = []
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        i, one = 0, []
        while i < len(p):
            if p[i] == "*":
                one.append("[^/]*")
            elif p[i] == "?":
                one.append("[^/]")
            elif p[i] == "[":
                part, i = _class(p, i)
                one.append(part)
            else:
                one.append(re.escape(p[i]))
            i += 1
        out.append("".join(one) + ("" if last else "/"))
    return "^" + "".join(out) + "$"
