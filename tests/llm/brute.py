"""Slow and plain versions of the operators, for comparison."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words(text: str) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(text: str, n: int) -> list[tuple[str, ...]]:
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []


def line_dedup(rows):
    """[(doc_id, text)] -> [(doc_id, text)], first occurrence by (doc_id, line), null ids last."""
    first: dict[str, tuple] = {}
    place = lambda d, i: (d is None, d or 0, i)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r"):
                first[line] = min(first.get(line, (True, math.inf, 0)), place(d, i))
    return [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip(" \t\r") or first[x] == place(d, i))) for d, t in rows]


def jaccard_pairs(rows, n=3, threshold=0.5):
    sets = sorted({(d, frozenset(grams(t, n))) for d, t in rows if d is not None and t is not None and grams(t, n)}, key=lambda x: x[0])
    out = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and (j := len(x & y) / len(x | y)) >= threshold - 1e-12:
                out.append((a, b, round(j, 9)))
    return sorted(out)


def components(pairs):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def near_sets(rows, n=3, threshold=0.5):
    """({(doc_id, set)}, root of each set, sets near each set); rows without doc_id left out."""
    docs = {(d, frozenset(grams(t, n))) for d, t in rows if d is not None}
    sets = sorted({s for _, s in docs if s}, key=sorted)
    near = {s: [] for s in sets}
    for i, x in enumerate(sets):
        for y in sets[i + 1 :]:
            if len(x & y) / len(x | y) >= threshold - 1e-12:
                near[x].append(y)
                near[y].append(x)
    root = components([(i, sets.index(y)) for i, x in enumerate(sets) for y in near[x]])
    return docs, {s: root.get(i, i) for i, s in enumerate(sets)}, near


def classes(rows, n=3, threshold=0.5):
    """[(doc_id, class_id, links)]"""
    docs, root, near = near_sets(rows, n, threshold)
    weight = Counter(s for _, s in docs)
    low: dict = {}
    for d, s in docs:
        if s:
            low[root[s]] = min(low.get(root[s], d), d)
    return [(d, low[root[s]], weight[s] - 1 + sum(weight[y] for y in near[s])) if s else (d, d, 0) for d, s in docs]


def keep_one(rows):
    """Rows that stay; of a class, the lowest doc_id's, and which of its rows is free (a set of texts for each)."""
    docs, root, _ = near_sets(rows)
    low: dict = {}
    for d, s in docs:
        if s:
            low[root[s]] = min(low.get(root[s], d), d)
    free, stay = {}, []
    for d, t in rows:
        s = frozenset(grams(t, 3))
        if d is None or not s:
            stay.append((d, t))
        elif low[root[s]] == d:
            free.setdefault(root[s], set()).add((d, t))
    return stay, list(free.values())


def contained(rows, items, n=5, threshold=0.8):
    out = []
    for d, t in rows:
        g = grams(t, n)
        for item, it in items:
            own = grams(it, n)
            s = set(own)
            if not s:
                continue
            best = max((len(s & set(g[i : i + len(own)])) for i in range(len(g))), default=0)
            if best >= max(1, math.ceil(threshold * len(s) - 1e-9)):
                out.append((d, item, best / len(s)))
    return out


def hilbert(point: list[int], bits: int) -> int:
    """Place on the curve by walking the cube's orthants, after Hamilton's formulation of the same curve as Skilling's."""
    x = list(point)
    n, m = len(x), 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str((v >> b) & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def pack(keyed, capacity):
    """[(key, doc_id, n, tie)] -> pieces (seq, offset, doc_id, doc_offset, n)."""
    out, at = [], 0
    for _, d, n, _ in sorted(keyed, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        done = 0
        while done < n:
            seq, off = divmod(at + done, capacity)
            k = min(n - done, capacity - off)
            out.append((seq, off, d, done, k))
            done += k
        at += n
    return out


def naive_bayes(train, texts, columns, buckets, alpha):
    """Languages by a plain loop over counts; ``columns`` gives the hashed n-grams of one text."""
    counts: dict[str, Counter] = {}
    for lang, t in train:
        counts.setdefault(lang, Counter()).update(columns(t))
    langs = sorted(counts)
    total = {k: sum(c.values()) + alpha * buckets for k, c in counts.items()}
    out = []
    for t in texts:
        cols = Counter(columns(t))
        s = {k: sum(n * math.log((counts[k][c] + alpha) / total[k]) for c, n in cols.items()) for k in langs}
        best = max(langs, key=lambda k: (s[k], [-ord(c) for c in k]))
        out.append((best, s[best], sum(cols.values()), 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


class Site:
    """The style tree of one host's distinct pages that aren't near copies, by nested tuples instead of hashes; after the module's definitions."""

    def __init__(self, roots, grams, sample, gamma, threshold, rare):
        self.gamma, self.threshold, self.rare = gamma, threshold, rare
        self.styles: dict = {}  # element -> style -> pages
        self.features: dict = {}  # text -> feature -> pages
        self.shown: dict = {}  # text -> pages of the style it stands in
        for root in roots:
            self._add(("root",), root, grams, sample)

    def _add(self, element, node, grams, sample):
        if node.text is not None:
            for f in {*grams(node.text)[:sample], *([] if node.link is None else [("link", node.link)])}:
                own = self.features.setdefault(element, Counter())
                own[f] += 1
            return
        style = (element, tuple(c.look for c in node.children))
        self.styles.setdefault(element, Counter())[style] += 1
        for i, c in enumerate(node.children):
            self.shown.setdefault((style, i), 0)
            self.shown[(style, i)] += 1
            self._add((style, i), c, grams, sample)

    def scores(self, element):
        """(composite importance, highest in the branch)"""
        if element in self.features:
            k, m = self.features[element], self.shown[element]
            if m < 2 or all(v < 2 for v in k.values()):
                return 1.0, 1.0
            s = 1 - sum(v * math.log(v) for v in k.values()) / sum(k.values()) / math.log(m)
            return s, s
        styles = self.styles[element]
        m, l = sum(styles.values()), len(styles)
        if m < 2:
            return 1.0, 1.0
        own = sum(-v / m * math.log(v / m) for v in styles.values()) / math.log(m)
        single = sum(v == 1 for v in styles.values())
        total, top = float(single), 1.0 if single > self.rare * m else 0.0
        for style, v in styles.items():
            if v > 1:
                inner = [self.scores((style, i)) for i in range(len(style[1]))]
                total += v * (sum(a for a, _ in inner) / len(inner) if inner else own)
                top = max([top, *(b for _, b in inner)])
        fade = self.gamma**l
        score = (1 - fade) * total / m + fade * own
        return score, max(top, score)

    def text(self, root, block):
        out: list[str] = []

        def visit(element, node):
            if (element in self.styles or element in self.features) and self.scores(element)[1] < self.threshold:
                return
            if node.text is not None:
                out.append(node.text)
                return
            style = (element, tuple(c.look for c in node.children))
            edge = "\n" if node.look.split(" ")[0] in block else ""
            out.append(edge)
            for i, c in enumerate(node.children):
                visit((style, i), c)
            out.append(edge)

        visit(("root",), root)
        lines = (" ".join(re.split("[ \t\n\r\f]+", x)).strip(" \t\n\r\f") for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x.strip())


def lcs(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def quality(rows, m):
    """(doc_id, lang, source) that stay of [(doc_id, text, lang, source)], by plain loops; ``m`` gives the constants."""

    def bins(t):
        w = words(t)
        part = lambda k, a, b: (a + m.PRIOR[k][0]) * m.BINS[k] // (b + m.PRIOR[k][1])
        return {
            "symbols": part("symbols", sum(t.count(c) for c in m.SYMBOLS), sum(c not in " \t\n\r\f\v" for c in t)),
            "capitals": part("capitals", sum("A" <= c <= "Z" for c in t), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in t)),
            "repeats": part("repeats", sum(a == b for a, b in zip(w, w[1:])), len(w)),
            "word_bytes": part("word_bytes", sum(len(x.encode()) for x in w), len(w)),
        }

    have = [(d, lang, source, bins(t)) for d, t, lang, source in rows if t is not None and words(t)]

    def quartiles(some, k):
        v = sorted(x[3][k] for x in some)
        at = lambda q: v[-(-len(v) * q // 4) - 1]
        return at(1), at(3)

    out = []
    for d, lang, source, x in have:
        own = [y for y in have if y[1:3] == (lang, source)]
        if len(own) < m.MIN_GROUP:
            own = [y for y in have if y[1] == lang]
        if len(own) < m.MIN_GROUP:
            own = have
        for k in m.MEASURES:
            a, b = quartiles(own, k)
            reach = m.FENCE * max(b - a, m.LEAST[k])
            if x[k] > b + reach or (k == "word_bytes" and x[k] < a - reach):
                break
        else:
            out.append((d, lang, source))
    return out
