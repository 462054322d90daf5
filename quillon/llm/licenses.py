"""License scan by conditional compression.

Lines that hold a trigger word (``TRIGGERS``) or a licence's name (``NAMES``) are found before text leaves the JVM
in documents that have none.  Around them, as far as the longest template reaches, each template is sought in ranges of
whole lines, so that wrapped wording is found whatever its width and wherever blank lines stand in it; the confirmed range with the fewest
differences is a candidate block, with the copyright lines beside it, longer templates first.  What trigger lines are left form blocks by runs.  Each block, in lower case with white space collapsed, is compressed by zstandard with each
template as a raw-content dictionary, and without one; what the dictionary saves is the share
``1 - with / without``.  The template that saves most (ties: the one named first) is confirmed by the exact wording: the
template's words missing from the block and the block's words that aren't the template's, by longest common
subsequence; if it isn't confirmed, the next in that order is tried, and of those confirmed the one with the fewest such words wins.  ``verdict`` is ``exact`` if neither is left but copyright lines, ``modified`` if at most ``MISSING``
of the template's words are missing and all its naming words (``MARKS``) are there in order, else ``unconfirmed``.

A mapped pass only; templates and their dictionaries are a few KB built in each worker.

Defined results: null and empty texts have no block; every block gives a row, unconfirmed ones too; a block
repeated, in a document or in repeated rows, gives a row each time; columns other than doc_id and text are ignored. A
line is taken whole however long it is.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings

TRIGGERS = ("licen", "copyright", "rights reserved", "public domain", "permission", "redistribut", "warrant", "spdx")
#: Names that make a candidate without a trigger word, in Python's and Java's regular expressions alike.
NAMES = r"(?<![0-9a-z])(?:[al]?gpl(?:v?[0-9.]+)?|cc[ -]by(?:-[a-z]{2})*|cc0|mpl|bsd|creative commons)(?![0-9a-z])"
#: One of these is in every such name; they are sought first, as a plain search is faster.
NAME_PARTS = ("gpl", "cc by", "cc-by", "cc0", "mpl", "bsd", "creative commons")
MISSING, LEVEL = 0.25, 19
#: Templates of fewer words than SHORT must stand in a block without a gap.
SHORT = 5

#: (name, wording, naming words); the wordings are the licences' own.
TEMPLATES = (
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "Licensed under the MIT license.", "mit license"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + (_AS_IS := "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
        "permission granted free of charge software as is",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "permission granted free of charge software",
    ),
    ("MIT", "MIT License", "mit license"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    (
        "Apache-2.0",
        (_APACHE := "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
        "apache 2 0",
    ),
    (
        "Apache-2.0",
        _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "apache 2 0 unless required as is basis",
    ),
    (
        "BSD-2-Clause",
        (_BSD := "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
        + (_BSD_AS_IS := "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
        "redistribution source binary forms redistributions redistributions disclaimed",
    ),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_AS_IS,
        "redistribution source binary forms redistributions redistributions neither name endorse disclaimed",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "permission with or without fee granted disclaims",
    ),
    *(
        (
            f"GPL-{v}.0",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either " + f"version {v} of the License, or (at your option) any later version. "
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            f"gnu general public license version {v}",
        )
        for v in (2, 3)
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public license 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license 3"),
    ("GPL-2.0", "Distributed under GPL version 2.", "gpl version 2"),
    ("GPL-3.0", "Distributed under GPL version 3.", "gpl version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public license 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public license 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license 2 0"),
    ("CC-BY-4.0", "CC BY 4.0", "cc by 4 0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "cc by sa 4 0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "cc by nc 4 0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "cc by nd 4 0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain.", "cc0 1 0"),
    ("CC0-1.0", "Released under CC0 1.0.", "cc0 1 0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("Proprietary", "All rights reserved.", "all rights reserved"),
)

_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
#: A line of a copyright notice has a year, a sign or "by": wrapped wording may begin with "copyright holders".
_COPYRIGHT = re.compile(r"^\W*(copyright\b(?=.*(?:\d{4}|\(c\)|©|\bby\b))|\(c\)|©).*$")
_NAMES = re.compile(NAMES)
_WORDS = [(name, _WORD.findall(wording.lower()), marks.split()) for name, wording, marks in TEMPLATES]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def blocks(text: str, triggers: tuple[str, ...] = TRIGGERS):
    """(first line, last line, block) of every candidate; lines count from 0."""
    lines = text.split("\n")
    low = [x.lower() for x in lines]
    hit = [i for i, x in enumerate(low) if any(t in x for t in triggers) or _NAMES.search(x)]
    if not hit:
        return
    words = [() if _COPYRIGHT.match(x) else _WORD.findall(x) for x in low]
    owner: dict[int, tuple[int, int]] = {}
    todo = 0
    while todo < len(hit):  # a stretch of lines that one template can't reach beyond
        first = _reach(words, hit[todo], -1)
        last = _reach(words, hit[todo], 1)
        todo += 1
        while todo < len(hit) and _reach(words, hit[todo], -1) <= last:
            last = _reach(words, hit[todo], 1)
            todo += 1
        for at in _found(words, first, last, hit):
            for i in range(at[0], at[1] + 1):
                owner[i] = at
    for step in (-1, 1):  # copyright lines go with the wording below them, else above
        for i in hit if step > 0 else reversed(hit):
            if i not in owner and _COPYRIGHT.match(low[i]):
                k = i - step
                while 0 <= k < len(lines) and not low[k].strip():
                    k -= step
                if k in owner:
                    old = owner[k]
                    new = (min(i, old[0]), max(i, old[1]))
                    for j in range(new[0], new[1] + 1):
                        owner[j] = new
    left = [i for i in hit if i not in owner]
    runs: list[list[int]] = []
    for i in left:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    for i, j in sorted({*owner.values(), *map(tuple, runs)}):
        yield i, j, "\n".join(lines[i : j + 1])


def _reach(words: list, at: int, step: int) -> int:
    """The line as far from ``at`` as the longest template, changed as much as it may be, reaches."""
    most = max(len(w) for _, w, _ in _WORDS) * (1 + MISSING)
    gaps = 0
    while 0 <= at + step < len(words) and most > 0 and gaps < 50:
        at += step
        most -= len(words[at])
        gaps += not words[at]
    return at


def _found(words: list, first: int, last: int, hit: list[int]) -> list[tuple[int, int]]:
    """Ranges of lines, first..last at most, each of which holds one template's wording and a line of ``hit``."""
    taken: set[int] = set()
    out = []
    have = Counter(w for x in words[first : last + 1] for w in x)
    near = {i for i in hit if first <= i <= last}
    for _, wording, marks in sorted(_WORDS, key=lambda t: -len(t[1])):
        need, n = Counter(wording), len(wording)
        if sum((need & have).values()) < (1 - MISSING) * n:
            continue
        fits = []
        for a in range(first, last + 1):
            if a in taken or not words[a]:
                continue
            got: list[str] = []
            for b in range(a, last + 1):
                if b in taken or (b > a and len(got) >= (1 + MISSING) * n):
                    break
                if not words[b]:
                    continue
                got = [*got, *words[b]]
                if near.isdisjoint(range(a, b + 1)) or sum((need & Counter(got)).values()) < (1 - MISSING) * n:
                    continue
                same = common(wording, got)
                if confirmed(wording, marks, got, n - same):
                    fits.append((n + len(got) - 2 * same, a, b))
        for _, a, b in sorted(fits):
            if taken.isdisjoint(range(a, b + 1)):
                out.append((a, b))
                taken.update(range(a, b + 1))
    return out


def _steps(wording: list[str], words: list[str]) -> list[int]:
    """Bits of the template's words, after each of the block's: a word's bit is cleared where the longest common subsequence grows."""
    places: dict[str, int] = {}
    for i, w in enumerate(wording):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(wording)) - 1
    v, out = full, []
    for w in words:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def common(wording: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of the template at a time."""
    steps = _steps(wording, words)
    return len(wording) - steps[-1].bit_count() if steps else 0


def differences(wording: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """(words of the template that are missing, words that aren't the template's), by a longest common subsequence; of several, the one with the latest words."""
    steps = _steps(wording, words)
    length = lambda i, j: i - (steps[j - 1] & ((1 << i) - 1)).bit_count() if j else 0
    i, j = len(wording), len(words)
    missing, extra = [], []
    while i and j:
        if wording[i - 1] == words[j - 1]:
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
            missing.append(wording[i])
        else:
            j -= 1
            extra.append(words[j])
    return (missing + wording[:i][::-1])[::-1], (extra + words[:j][::-1])[::-1]


def confirmed(wording: list[str], marks: list[str], words: list[str], missing: int) -> bool:
    if len(wording) < SHORT:
        return any(words[i : i + len(wording)] == wording for i in range(len(words)))
    return missing <= MISSING * len(wording) and _in_order(marks, words)


_tools: list = []


def _compressors():
    if not _tools:
        plain = zstandard.ZstdCompressor(level=LEVEL)
        made = []
        for name, wording, marks in TEMPLATES:
            d = zstandard.ZstdCompressionDict(normal(wording).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.append((name, _WORD.findall(wording.lower()), marks.split(), zstandard.ZstdCompressor(level=LEVEL, dict_data=d)))
        _tools.extend([plain, made])
    return _tools


def _in_order(marks: list[str], words: list[str]) -> bool:
    it = iter(words)
    return all(any(w == m for w in it) for m in marks)


def judge(block: str) -> tuple[str, float, list[str], list[str], str]:
    """(license, share saved, missing words, other words, verdict) of a block."""
    plain, made = _compressors()
    data = normal(block).encode("utf-8", "surrogatepass")
    base = len(plain.compress(data))
    saved = [1 - len(c.compress(data)) / base for *_, c in made]
    ranking = sorted(range(len(made)), key=lambda i: (-saved[i], i))
    body = "\n".join(x for x in block.lower().split("\n") if not _COPYRIGHT.match(x)) or block.lower()
    words = _WORD.findall(body)
    have, sure = Counter(words), []
    for place, i in enumerate(ranking):
        _, wording, marks, _ = made[i]
        if sum((Counter(wording) & have).values()) >= (1 - MISSING) * len(wording):
            same = common(wording, words)
            if confirmed(wording, marks, words, len(wording) - same):
                sure.append((len(wording) + len(words) - 2 * same, place, i))
    if sure:
        apart, _, best = min(sure)
        return made[best][0], saved[best], *differences(made[best][1], words), "modified" if apart else "exact"
    best = ranking[0]
    return made[best][0], saved[best], *differences(made[best][1], words), "unconfirmed"


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, first_line, last_line, license, saved, missing, extra, verdict)`` of every candidate block."""
    small_batches(docs)
    has = lambda low, words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    # an array of one, so that a text is put into lower case once for all searches
    some = F.transform(F.array(F.lower("text")), lambda low: has(low, TRIGGERS) | (has(low, NAME_PARTS) & low.rlike(NAMES)))[0]

    def run(batches):
        known: dict[str, tuple] = {}
        for b in batches:
            rows = []
            for i, text in enumerate(strings(b, "text").to_pylist()):
                for first, last, block in blocks(text):
                    got = known.get(block)
                    if got is None:
                        got = judge(block)
                        if len(block) < 1000 and len(known) < 10_000:  # a cache of short blocks already judged
                            known[block] = got
                    rows.append((i, first, last, *got))
            at, first, last, name, saved, missing, extra, verdict = zip(*rows) if rows else ((),) * 8
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(name, pa.string()), pa.array(saved, pa.float64()), pa.array(missing, pa.list_(pa.string())), pa.array(extra, pa.list_(pa.string())), pa.array(verdict, pa.string())],
                ["doc_id", "first_line", "last_line", "license", "saved", "missing", "extra", "verdict"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where(some).mapInArrow(run, f"doc_id {kind}, first_line int, last_line int, license string, saved double, missing array<string>, extra array<string>, verdict string")
