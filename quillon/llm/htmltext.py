"""HTML extraction by site style trees.

Pages of one host are merged into a style tree.  An element node is the place that an element has under its
parent's style; a style node is one sequence of children (tags with their presentation attributes) that
the element shows on some pages.  A node's importance is low where the site repeats itself:

* an inner element on m pages whose styles have shares p_i:  H(p), the entropy to base m;
* a text on m pages, its features on k_j pages each:  1 - sum k_j log_m k_j / sum k_j (each
  page's features weigh alike, so that a word that always changes doesn't hide those that don't);  features are all of its
  word ``GRAM``-grams and its link; single words, which the published method
  takes, would have articles of few different words taken for boilerplate;
* composite: (1 - g^l) * sum p_i * C(S_i) + g^l * own importance, l styles, C(S) the mean over
  S's children, g = ``GAMMA``.

A branch all of whose composites are below ``THRESHOLD`` t (a feature on k of m pages alone would be from k = m ^ (1 - t) on; styles that one page alone shows count as important if they make up
more than ``RARE`` of the branch's pages) is noise and is cut from every page that has it; what is left is
the page's text, one line per block element.  ``head``, scripts, styles, templates and comments are never text.

Pages whose long texts are near copies (one of ``BANDS`` min-wise keys in common) count once in the tree, else two copies alone
would make an article boilerplate.  A key of more than half of a host's pages is the site's own text and joins none.  Two pages
whose n-grams have a Jaccard similarity of 0.8 are found with probability 99.7 %, at 0.2 with 6 %; a page too many left
out of the tree is still cleaned.

Plan: pages are parsed once for the keys of near copies, which with the pages' hashes are all that is shuffled to find copies.  The copies (broadcast
up to 4 ``BROADCAST_BYTES``; beyond that pages are joined with them, and move) are left out when pages are parsed again; of exact copies one comes back.
Each task counts styles and features by node and sends one row a node.  A text of which few features come again in the task, as in articles, is sent
as prints, the first ``BITS`` bits of each feature's hash: features that share a print can only make a text look more alike, so one that
is important by its prints is important, and as nothing above an important text is ever cut, its exact score isn't needed.  What prints leave
open is counted by whole features, from the pages of those hosts.  So every decision is by exact counts of all features.  The task that merges a
node holds an element's different styles, 16 bytes each, and of a text at most a table of prints.
Nodes that one page alone has are important by definition and go no further, so what is left of a host is the structure its pages share.  A host of at most ``NODES`` such rows is solved in one task; a larger one level by level, deepest
first, by joins of children with their parents' styles, whatever its size.  The noise branches of a host, up to ``BRANCHES``, are one row, joined to its pages
(broadcast if all of them are under ``BROADCAST_BYTES``), which are parsed again and cut; of a host with more, each page gets those it has.

Defined results: pages without a readable host, and hosts with one distinct page, are kept whole; exact copies
within a host count as one page in the tree, as near copies do, and each is cleaned; null html gives null text, empty html the empty text;
markup is read leniently (unclosed and stray tags, raw text in scripts) and whole, however long a page is; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches, written

GAMMA, THRESHOLD, RARE, BROADCAST_BYTES = 0.9, 0.85, 0.05, 8 << 20
NODES, BRANCHES = 200_000, 2_000
#: Features of a text: its GRAM-grams, all of them (SAMPLE: None).  Near copies: BANDS keys of ROWS minima over texts of LONG n-grams or more.
GRAM, SAMPLE, LONG, BANDS, ROWS = 3, None, 6, 8, 3
#: A task counts about AT_ONCE features and nodes before it sends them.  A text's features are sent whole if they are FEW there, or at most MANY and come again; else as prints of BITS bits.
AT_ONCE, FEW, MANY, BITS, HELD = 4_000_000, 32, 4096, 24, 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|head|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
_LOOK = re.compile(r"\b(class|id|style|width|height|align|bgcolor|color|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_LINK = re.compile(r"\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_GAP = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("look", "children", "text", "link", "block")

    def __init__(self, look: str, text: str | None = None, link: str | None = None, block: bool = False):
        self.look, self.text, self.link, self.block, self.children = look, text, link, block, []


def parse(source: str) -> Node:
    """The tree of a page; text is a child of its own, with white space collapsed."""
    root = Node("#root")
    stack, names = [root], ["#root"]
    for m in _TOKEN.finditer(source):
        name = m.group(3)
        if name is None:
            piece = m.group(0)
            if piece[0] != "<" or piece == "<":
                text = htmllib.unescape(piece) if "&" in piece else piece
                if "\n" in text or "  " in text or "\t" in text or "\r" in text or "\f" in text:
                    text = _GAP.sub(" ", text)
                if text != " ":
                    kids = stack[-1].children
                    if kids and kids[-1].text is not None:
                        kids[-1].text += text
                    else:
                        kids.append(Node("#text", text, stack[-1].link))
            continue
        name = name.lower()
        if m.group(2):
            if name in names:
                while names.pop() != name:
                    stack.pop()
                stack.pop()
            continue
        if name in _CLOSES_P and "p" in names:
            while names.pop() != "p":
                stack.pop()
            stack.pop()
        elif name in _SAME:
            for k in range(len(names) - 1, 0, -1):
                if names[k] in _FENCE[name]:
                    break
                if names[k] in _SAME[name]:
                    del names[k:], stack[k:]
                    break
        attrs = m.group(4)
        look = name
        if "=" in attrs:
            look += "".join(sorted(f" {a.lower()}={v.strip(chr(34) + chr(39))}" for a, v in _LOOK.findall(attrs)))
        link = _LINK.search(attrs) if name == "a" and attrs else None
        node = Node(look, None, link and link.group(1).strip("\"'"), name in BLOCK)
        stack[-1].children.append(node)
        if name not in VOID and not attrs.endswith("/"):
            stack.append(node)
            names.append(name)
    return root


_hash = xxhash.xxh64_intdigest


def _key(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def style_of(key: int, node: Node) -> tuple[int, list[int]]:
    """(style node, element nodes of its children) of an element node's appearance on a page."""
    style = _hash("\x00".join([f"s\x00{key}", *(c.look for c in node.children)]).encode("utf-8", "surrogatepass"))
    return style, [_hash(f"e\x00{style}\x00{i}") for i in range(len(node.children))]


ROOT = _key("root")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts) of the different word ``GRAM``-grams of some texts, by text, least first; of all words of a shorter one, or of a text without a word."""
    h, _, _, per = tk.words(*tk.buffers(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary())))
    g, doc, _ = tk.ngrams(h, per, GRAM)
    bare = np.flatnonzero(np.diff(per) == 0)
    g = np.concatenate((g, np.fromiter((_key("f", texts[i].strip()) for i in bare.tolist()), np.uint64, len(bare))))
    doc = np.concatenate((doc, bare))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])) if len(g) else np.zeros(0, np.bool_)
    return g[new], doc[new]


def walk(root: Node):
    """(element node, style node, its children, text or None, link, depth) of everything on a page."""
    todo = [(ROOT, root, 0)]
    while todo:
        key, node, depth = todo.pop()
        if node.text is not None:
            yield key, 0, 0, node.text, node.link, depth
        else:
            style, kids = style_of(key, node)
            yield key, style, len(kids), None, None, depth
            depth += 1
            todo.extend((k, c, depth) for k, c in zip(kids, node.children))


_MIX = np.random.default_rng(8).integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def bands(g: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, pages), pages in order, that pages with nearly the same long texts have in common, from their n-grams; never 0."""
    start = np.flatnonzero(np.append(True, page[1:] != page[:-1])) if len(page) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), start
    keys = np.zeros((BANDS, len(start)), np.uint64)
    for i in range(BANDS):
        for r in range(ROWS):
            keys[i] = tk.mix(keys[i] ^ np.minimum.reduceat(g * _MIX[i * ROWS + r] >> np.uint64(16), start) ^ np.uint64(i + 1))
    return np.maximum(keys, np.uint64(1)).T.reshape(-1), np.repeat(page[start], BANDS)


def near_keys(pages: list[str]) -> list[bytes]:
    """Each page's keys of near copies, from the n-grams of its long texts."""
    texts, where = [], []
    for i, source in enumerate(pages):
        todo = [parse(source)]
        while todo:
            node = todo.pop()
            if node.text is None:
                todo.extend(node.children)
            elif len(node.text) >= 2 * (GRAM + LONG - 1) - 1:  # LONG different n-grams need so many words
                texts.append(node.text)
                where.append(i)
    g, doc = features(texts)
    long = np.bincount(doc, minlength=len(texts))[doc] >= LONG
    key, page = bands(g[long], np.array(where, np.int64)[doc[long]])
    ends = np.cumsum(np.bincount(page, minlength=len(pages)))
    return [key[a:z].tobytes() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of some sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), np.bool_)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _lengths(start: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(start, total))


def _varints(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each) of integers below 2^28, seven bits a byte, the last one below 128."""
    size = 1 + (d >= 1 << 7) + (d >= 1 << 14) + (d >= 1 << 21)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        out[at[has] + k] = (d[has] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127) | (np.uint8(128) * (size[has] > k + 1)).astype(np.uint8)
    return out, size


def _prints(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(prints, which text of ``raw`` each is from) of lists of prints, each the varints of a sorted list's differences."""
    x = np.frombuffer(b"".join(raw), np.uint8)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.flatnonzero(x < 128)
    start = np.append(0, end[:-1] + 1)
    place = np.arange(len(x)) - np.repeat(start, end - start + 1)
    v = np.cumsum(np.add.reduceat((x & 127).astype(np.int64) << (7 * place), start))
    stops = np.cumsum([len(r) for r in raw])
    owner = np.searchsorted(stops, start, "right")
    first = _runs(owner)
    before = np.append(0, v[first[1:] - 1])
    return v - np.repeat(before, _lengths(first, len(v))), owner


_STYLE = np.dtype([("style", "<u8"), ("kids", "<i4"), ("n", "<i4")])
_FEATURE = np.dtype([("value", "<u8"), ("n", "<i4")])
_COUNTS = "host string, node long, kind int, depth int, pages long, data binary"
ELEMENT, EXACT, PRINTS = 0, 1, 2


class Counts:
    """Counts of the styles and of all features of many pages, by host and node."""

    def __init__(self):
        self.hosts: dict[str, int] = {}
        self.styles, self.texts, self.features, self.size, self.n = [], [], [], 0, 0

    def add(self, hosts: list[str], pages: list[str]) -> None:
        own, texts, at, links = [], [], [], []
        for host, source in zip(hosts, pages):
            h = self.hosts.setdefault(host, len(self.hosts))
            for key, style, kids, text, link, depth in walk(parse(source)):
                if text is None:
                    own.append((h, key, style, kids, depth))
                else:
                    if link is not None:
                        links.append((_key("l", link), len(texts)))
                    texts.append(text)
                    at.append((h, key, depth))
        g, doc = features(texts)
        column = lambda rows, k, t: np.array([r[k] for r in rows], t)
        self.styles.append([column(own, k, t) for k, t in enumerate((np.int64, np.uint64, np.uint64, np.int32, np.int32))])
        self.texts.append([column(at, k, t) for k, t in enumerate((np.int64, np.uint64, np.int32))])
        self.features.append([np.concatenate((g, column(links, 0, np.uint64))), np.concatenate((doc, column(links, 1, np.int64))) + self.n])
        self.n += len(texts)
        self.size += len(self.features[-1][0]) + len(own)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """``_COUNTS`` of what was added since the last call, by host and node."""
        if not self.styles:
            return
        names = pa.array(list(self.hosts), pa.string())
        h, node, style, kids, depth = (np.concatenate(c) for c in zip(*self.styles))
        order = np.lexsort((style, node, h))
        h, node, style, kids, depth = (c[order] for c in (h, node, style, kids, depth))
        run = _runs(h, node, style)
        each = np.zeros(len(run), _STYLE)
        each["style"], each["kids"], each["n"] = style[run], kids[run], _lengths(run, len(h))
        h, node, depth = h[run], node[run], depth[run]
        first = _runs(h, node)
        stop = np.append(first[1:], len(h))
        parts = [(h[first], node[first], np.full(len(first), ELEMENT), depth[first], np.add.reduceat(each["n"], first), [each[a:z].tobytes() for a, z in zip(first.tolist(), stop.tolist())])]

        h, node, depth = (np.concatenate(c) for c in zip(*self.texts))
        if len(h):
            order = np.lexsort((node, h))
            first = _runs(h[order], node[order])
            pages = _lengths(first, len(h))
            which = np.empty(len(h), np.int64)
            which[order] = np.repeat(np.arange(len(first)), pages)
            h, node, depth = (c[order][first] for c in (h, node, depth))
            g, doc = (np.concatenate(c) for c in zip(*self.features))
            owner = which[doc]
            prints = np.sort(owner.astype(np.uint64) << np.uint64(BITS) | g >> np.uint64(64 - BITS))
            total = np.bincount(owner, minlength=len(first))
            different = np.bincount((prints[_runs(prints)] >> np.uint64(BITS)).astype(np.int64), minlength=len(first))
            exact = (different <= FEW) | (2 * total >= 3 * different) & (different <= MANY)
            mine = exact[owner]
            g, owner = g[mine], owner[mine]
            order = np.lexsort((g, owner))
            g, owner = g[order], owner[order]
            run = _runs(owner, g)
            each = np.zeros(len(run), _FEATURE)
            each["value"], each["n"] = g[run], _lengths(run, len(g))
            stop = np.cumsum(np.bincount(owner[run], minlength=len(first)))
            start = stop - np.bincount(owner[run], minlength=len(first))
            parts.append((*(c[exact] for c in (h, node)), np.full(int(exact.sum()), EXACT), depth[exact], pages[exact], [each[a:z].tobytes() for a, z in zip(start[exact].tolist(), stop[exact].tolist())]))
            owner = (prints >> np.uint64(BITS)).astype(np.int64)
            prints, owner = prints[~exact[owner]] & np.uint64((1 << BITS) - 1), owner[~exact[owner]]
            run = _runs(owner)
            step = prints.copy()
            step[1:] -= prints[:-1]
            step[run] = prints[run]
            raw, size = _varints(step)
            stop = np.cumsum(np.add.reduceat(size, run)) if len(run) else np.zeros(0, np.int64)
            start = np.append(0, stop[:-1])
            raw, rest = raw.tobytes(), owner[run]
            parts.append((h[rest], node[rest], np.full(len(rest), PRINTS), depth[rest], pages[rest], [raw[a:z] for a, z in zip(start.tolist(), stop.tolist())]))
        h, node, kind, depth, pages = (np.concatenate([p[k] for p in parts]) for k in range(5))
        data = [x for p in parts for x in p[5]]
        order = np.lexsort((node, h))
        for i in range(0, len(order), 1000):
            o = order[i : i + 1000]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(h[o])), pa.array(node[o].view(np.int64)), pa.array(kind[o], pa.int32()), pa.array(depth[o], pa.int32()), pa.array(pages[o], pa.int64()), pa.array([data[k] for k in o.tolist()], pa.binary())], [c.split(" ")[0] for c in _COUNTS.split(", ")])
        self.__init__()


_TREE = "host string, kind int, node long, imp double, l long, m long, single long, text boolean, style long, kids int, depth int"
NODE, STYLE, OPEN = 0, 1, 2


def _nlogn(n: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(group, n * np.log(n), groups).astype(np.float64)  # without rows, bincount gives integers


def _merged(rows: list[tuple], dense: np.ndarray | None = None) -> pa.RecordBatch:
    """``_TREE`` of all rows of ``_COUNTS``, in order, of some nodes; of a text whose prints leave its importance open, one of kind ``OPEN``.  dense: further prints of a single text, by print."""
    hosts, node, kind, depth, pages, data = (list(c) for c in zip(*rows))
    node, kind, depth, pages = np.array(node, np.int64), np.array(kind), np.array(depth), np.array(pages, np.int64)
    new = np.array([True, *(a != b for a, b in zip(hosts[1:], hosts))]) | np.append(True, node[1:] != node[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    groups = len(first)
    element = kind[first] == ELEMENT
    m, l, single = (np.zeros(groups, np.int64) for _ in range(3))

    def entries(k, dtype):
        at = np.flatnonzero(kind == k)
        e = np.frombuffer(b"".join(data[i] for i in at.tolist()), dtype)
        return e, np.repeat(group[at], [len(data[i]) // dtype.itemsize for i in at.tolist()])

    def summed(value, n, own):
        order = np.lexsort((value, own))
        value, n, own = value[order], n[order], own[order]
        run = _runs(own, value)
        return order[run], np.add.reduceat(n, run) if len(run) else n, own[run]

    e, own = entries(ELEMENT, _STYLE)
    at, n, own = summed(e["style"], e["n"].astype(np.int64), own)
    rest = _nlogn(n, own, groups)
    m += np.bincount(own, n, groups).astype(np.int64)
    l += np.bincount(own, minlength=groups)
    single += np.bincount(own[n == 1], minlength=groups)
    shown = n > 1
    styles = (own[shown], n[shown], e["style"][at][shown].view(np.int64), e["kids"][at][shown])

    rough = np.zeros(groups, np.bool_)
    rough[group[kind == PRINTS]] = True
    if dense is not None:
        rough[:] = True
    e, own = entries(EXACT, _FEATURE)
    fine = ~rough[own]
    _, n, whose = summed(e["value"][fine], e["n"][fine].astype(np.int64), own[fine])
    rest += _nlogn(n, whose, groups)
    m += np.bincount(whose, n, groups).astype(np.int64)
    l += np.bincount(whose, minlength=groups)
    single += np.bincount(whose[n == 1], minlength=groups)
    if rough.any():
        at = np.flatnonzero(kind == PRINTS)
        v, owner = _prints([data[i] for i in at.tolist()])
        v = np.concatenate((v, (e["value"][~fine] >> np.uint64(64 - BITS)).astype(np.int64)))
        n = np.concatenate((np.ones(len(owner), np.int64), e["n"][~fine].astype(np.int64)))
        if dense is None:
            _, n, whose = summed(v, n, np.concatenate((group[at][owner], own[~fine])))
        else:
            np.add.at(dense, v, n)
            n = dense[dense > 0]
            whose = np.zeros(len(n), np.int64)
        rest += _nlogn(n, whose, groups)
        m += np.bincount(whose, n, groups).astype(np.int64)
    total = np.bincount(group, pages, groups)
    # features that share a print count as one, which can only make rest larger: a text that is important all the same is
    least = 1 - rest / np.maximum(m, 1) / np.log(np.maximum(total, 2))
    undecided = rough & (rest > 0) & (least < THRESHOLD + 1e-9)
    keep = np.flatnonzero(np.where(element, m > 1, ~rough & (rest > 0)) | undecided)
    k = np.concatenate((np.where(undecided[keep], OPEN, NODE), np.full(len(styles[0]), STYLE)))
    g = np.concatenate((keep, styles[0]))
    none = np.zeros(len(styles[0]), np.int64)
    both = lambda a, b: np.concatenate((a, b))
    zero = np.zeros(len(keep), np.int64)
    columns = [
        pa.array([hosts[i] for i in first[g].tolist()], pa.string()), pa.array(k, pa.int32()), pa.array(node[first][g]), pa.array(both(rest[keep] / m[keep], none.astype(float))), pa.array(both(l[keep], none)),
        pa.array(both(m[keep], styles[1])), pa.array(both(single[keep], none)), pa.array(both(~element[keep], none > 0)), pa.array(both(zero, styles[2])), pa.array(both(zero, styles[3]), pa.int32()), pa.array(depth[first][g], pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _TREE.split(", ")])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_TREE`` of ``_COUNTS`` sorted by host and node.  A text of more than ``HELD`` bytes is counted by print, in a table of 2^BITS."""
    rows: list[tuple] = []
    held, last, dense = 0, 0, None  # bytes in rows; the row where the latest node begins; prints of that node
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if rows and (r[0], r[1]) != rows[-1][:2]:
                if dense is not None or held > HELD:
                    yield _merged(rows, dense)
                    rows, held, dense = [], 0, None
                last = len(rows)
            rows.append(r)
            held += len(r[5])
            if held > HELD and r[2] != ELEMENT:
                if last:
                    yield _merged(rows[:last])
                    rows, last = rows[last:], 0
                    held = sum(len(x[5]) for x in rows)
                if held > HELD:
                    if dense is None:
                        dense = np.zeros(1 << BITS, np.int64)
                    v, _ = _prints([x[5] for x in rows if x[2] == PRINTS])
                    np.add.at(dense, v, 1)
                    e = np.frombuffer(b"".join(x[5] for x in rows if x[2] == EXACT), _FEATURE)
                    np.add.at(dense, (e["value"] >> np.uint64(64 - BITS)).astype(np.int64), e["n"].astype(np.int64))
                    rows = [(*r[:4], sum(x[4] for x in rows), b"")]
                    rows[0] = (*rows[0][:2], PRINTS, *rows[0][3:])
                    held = 0
    if rows:
        yield _merged(rows, dense)


_EDGE = (0, None)


def clean_text(root: Node, noise: frozenset[int] | set[int]) -> str:
    """The page's text without the branches whose element nodes are ``noise``."""
    out: list[str] = []

    def visit(key: int, node: Node) -> None:
        todo = [(key, node)]
        while todo:
            key, node = todo.pop()
            if node is None:
                out.append("\n")
                continue
            if noise and key in noise:
                continue
            if node.text is not None:
                out.append(node.text)
                continue
            if node.block:
                out.append("\n")
                todo.append(_EDGE)
            if noise:
                todo.extend(zip(reversed(style_of(key, node)[1]), reversed(node.children)))
            else:
                todo.extend((0, c) for c in reversed(node.children))

    visit(ROOT, root)
    lines = (x.strip() for x in "".join(out).split("\n"))
    return "\n".join(_GAP.sub(" ", x) if "  " in x else x for x in lines if x)


def host_of(url):
    """The host of an absolute URL, in lower case, without user and port; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][0-9a-zA-Z.+-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(h != "", h)


def _copies(known: DataFrame) -> DataFrame:
    """``(host, h1, h2, again)``: the pages of which not every row counts; again: one row does."""

    def read(batches):
        for b in batches:
            sources = b.column("html").to_pylist()
            done = [x for i in range(0, len(sources), 64) for x in near_keys(sources[i : i + 64])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("host", "h1", "h2")), pa.array(done, pa.binary())], ["host", "h1", "h2", "keys"])

    def spread(batches):
        for b in batches:
            raw = b.column("keys").to_pylist()
            owner = pa.array(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(owner) for c in ("host", "h1", "h2")), pa.array(np.frombuffer(b"".join(raw), np.int64))], ["host", "h1", "h2", "value"])

    parsed = known.mapInArrow(read, "host string, h1 long, h2 long, keys binary")
    distinct = written(parsed.groupBy("host", "h1", "h2").agg(F.count("*").alias("rows"), F.first("keys").alias("keys")), "pages")
    keys = distinct.select("host", "h1", "h2", "keys").mapInArrow(spread, "host string, h1 long, h2 long, value long")
    sites = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    groups = keys.groupBy("host", "value").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("first")).where("n > 1")
    copied = groups.join(sites, "host").where("2 * n <= pages").select("host", "value", "first")
    near = keys.join(copied, ["host", "value"]).where(F.struct("h1", "h2") > F.col("first")).select("host", "h1", "h2", F.lit(False).alias("again"))
    more = distinct.where("rows > 1").select("host", "h1", "h2", F.lit(True).alias("again"))
    return written(near.unionByName(more).groupBy("host", "h1", "h2").agg(F.min("again").alias("again")), "copies")


def _counted(pages: DataFrame) -> DataFrame:
    """``(host, html)`` of the pages that count in the tree: each different one of a host once, near copies left out.  Only copies are shuffled."""
    known = pages.where("host is not null and html is not null").select("host", "html", F.xxhash64("html").alias("h1"), F.xxhash64(F.lit(1), "html").alias("h2"))
    copies = _copies(known)
    on = ["host", "h1", "h2"]
    sums = copies.agg(F.sum(F.length("host") + 17), F.max("again")).first()
    if sums[0] is None:
        return known.select("host", "html")
    small = lambda df: F.broadcast(df) if sums[0] <= 4 * BROADCAST_BYTES else df
    alone = known.join(small(copies), on, "left_anti").select("host", "html")
    if not sums[1]:
        return alone
    return alone.unionByName(known.join(small(copies.where("again")), on, "left_semi").dropDuplicates(on).select("host", "html"))


def _tree(pages: DataFrame) -> DataFrame:
    """``_TREE`` of all pages: nodes with their importance, and styles that two pages or more show.

    Each task counts what its pages have and sends one row a node.  The counts of texts of which few features come again are sent as
    prints of ``BITS`` bits; what they leave open is counted by whole features, from the pages of those hosts.
    """
    counted = _counted(pages)

    def count(batches):
        counts = Counts()
        for b in batches:
            hosts, sources = b.column("host").to_pylist(), b.column("html").to_pylist()
            for i in range(0, len(hosts), 64):
                counts.add(hosts[i : i + 64], sources[i : i + 64])
                if counts.size > AT_ONCE:
                    yield from counts.rows()
        yield from counts.rows()

    tree = written(counted.mapInArrow(count, _COUNTS).repartition("host", "node").sortWithinPartitions("host", "node").mapInArrow(_merge, _TREE), "tree")
    undecided = tree.where(F.col("kind") == OPEN)
    if undecided.isEmpty():
        return tree
    features_of = written(_features(counted, undecided), "features")
    n = F.col("n")
    exact = features_of.groupBy("host", "node").agg((F.sum(n * F.log(n.cast("double"))) / F.sum("n")).alias("imp"), F.count("*").alias("l"), F.sum("n").alias("m"), F.sum(F.when(n == 1, 1).otherwise(0)).alias("single")).where("imp > 0")
    again = exact.join(undecided.select("host", "node", "text", "style", "kids", "depth"), ["host", "node"]).withColumn("kind", F.lit(NODE))
    return tree.where(F.col("kind") != OPEN).unionByName(written(again.select(*tree.columns), "exact"))


def _features(counted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(host, node, value, n)``: the pages that have each feature of some texts."""

    def read(batches):
        for b in batches:
            wanted = _sets(b.column("branches"))
            for i, (source, own) in enumerate(zip(b.column("html").to_pylist(), wanted)):
                found = [(k, t, link) for k, _, _, t, link, _ in walk(parse(source)) if t is not None and k in own]
                g, doc = features([t for _, t, _ in found])
                links = [(k, _key("l", link)) for k, _, link in found if link is not None]
                at = np.concatenate((np.array([k for k, _, _ in found], np.uint64)[doc], np.array([k for k, _ in links], np.uint64)))
                value = np.concatenate((g, np.array([v for _, v in links], np.uint64)))
                yield pa.RecordBatch.from_arrays([b.column("host").take(pa.array([i] * len(at), pa.int64())), pa.array(at.view(np.int64)), pa.array(value.view(np.int64))], ["host", "node", "value"])

    lists = written(nodes.groupBy("host").agg(F.collect_list("node").alias("branches")), "open").withColumnRenamed("host", "site")
    size = lists.agg(F.sum(F.size("branches") * 8 + F.length("site"))).first()[0]
    of = counted.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, F.col("host") == F.col("site")).select("host", "html", "branches")
    return of.mapInArrow(read, "host string, node long, value long").groupBy("host", "node", "value").agg(F.count("*").alias("n"))


def _sets(lists: pa.Array) -> list[frozenset[int]]:
    """Node lists of rows, as sets of unsigned keys; rows of a host have the same list."""
    v, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    known: dict[bytes, frozenset] = {}
    out = []
    for i in range(len(lists)):
        raw = v[off[i] : off[i + 1]].tobytes() if lists[i].is_valid else b""
        if raw not in known:
            known[raw] = frozenset(np.frombuffer(raw, np.uint64).tolist())
        out.append(known[raw])
    return out


def branches(nodes: list, styles: list, gamma: float = GAMMA, threshold: float = THRESHOLD) -> list[int]:
    """Noise branches of one host, topmost nodes only.

    nodes: (node, own importance, styles, pages that have it, pages in which its style is shared by no other, is a text)
    of nodes on two pages or more; styles: (node, pages, children) of styles on two or more.
    """
    own = {n[0]: n for n in nodes}
    shown: dict[int, list] = {}
    for node, n, kids in styles:
        shown.setdefault(node, []).append((n, kids))
    score: dict[int, float] = {}
    worst: dict[int, float] = {}  # highest composite in the branch
    todo = [(ROOT_SIGNED, False)]
    while todo:
        k, ready = todo.pop()
        if k in score:
            continue
        if k not in own:  # on one page only
            score[k] = worst[k] = 1.0
            continue
        _, imp, l, m, single, text = own[k]
        if text:
            score[k] = worst[k] = imp
            continue
        if not ready:
            todo.append((k, True))
            todo.extend((c, False) for _, kids in shown.get(k, ()) for c in kids)
            continue
        total, top = single * 1.0, 1.0 if single > RARE * m else 0.0
        for n, kids in shown.get(k, ()):
            total += n * (sum(score[c] for c in kids) / len(kids) if kids else imp)
            top = max([top, *(worst[c] for c in kids)])
        fade = gamma**l
        score[k] = (1 - fade) * total / m + fade * imp
        worst[k] = max(top, score[k])
    out, todo = [], [ROOT_SIGNED]
    while todo:
        k = todo.pop()
        if worst[k] < threshold:
            out.append(k)
        elif k in shown:
            todo.extend(c for _, kids in shown[k] for c in kids)
    return out


ROOT_SIGNED = _signed(ROOT)


def _kids(style: int, n: int) -> list[int]:
    return [_signed(_key("e", style & 0xFFFFFFFFFFFFFFFF, i)) for i in range(n)]


def noise(pages: DataFrame) -> DataFrame:
    """``(host, node)`` of the topmost noise branches of all hosts; ``pages`` has host and html."""
    tree = _tree(pages)

    def solve(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, styles = [], []
        for b in parts:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    nodes.append((r["node"], r["imp"], r["l"], r["m"], r["single"], r["text"]))
                else:
                    styles.append((r["node"], r["m"], _kids(r["style"], r["kids"])))
        shown = {k: n for _, n, kids in styles for k in kids}
        nodes = [(k, 1 - rest / math.log(shown[k] if text else m), l, shown[k] if text else m, single, text) for k, rest, l, m, single, text in nodes]
        found = branches(nodes, styles)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(found), pa.string()), pa.array(found, pa.int64())], ["host", "node"])

    large = tree.groupBy("host").count().where(F.col("count") > NODES).select("host")
    solved = tree.join(large, "host", "left_anti").groupBy("host").applyInArrow(solve, "host string, node long")
    levels = tree.join(large, "host", "left_semi").agg(F.max("depth")).first()[0]
    return solved if levels is None else solved.unionByName(_by_level(written(tree.join(large, "host", "left_semi"), "large"), levels))


def _by_level(tree: DataFrame, levels: int) -> DataFrame:
    """What :func:`branches` gives, for hosts of any size: each level's composites from those of the level below, as a join and two aggregations."""

    def children(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                kids = [_kids(s, k) for s, k in zip(part.column("style").to_pylist(), part.column("kids").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("host", "node", "style", "m", "depth")), pa.array(kids, pa.list_(pa.int64()))], ["host", "node", "style", "n", "depth", "kids"])

    styles = written(tree.where("kind = 1").select("host", "node", "style", "m", "kids", "depth").mapInArrow(children, "host string, node long, style long, n long, depth int, kids array<long>"), "styles")
    parents = styles.select("host", "node", "n", F.explode("kids").alias("kid"), "depth")
    texts = tree.where("kind = 0 and text").join(parents.select("host", F.col("kid").alias("node"), F.col("n").alias("pages")), ["host", "node"])
    leaf = texts.select("host", "node", "depth", (1 - F.col("imp") / F.log(F.col("pages").cast("double"))).alias("score")).withColumn("worst", F.col("score"))
    elements = tree.where("kind = 0 and not text").select("host", "node", "depth", (1 - F.col("imp") / F.log(F.col("m").cast("double"))).alias("imp"), "l", "m", "single")
    done: list[DataFrame] = []
    below = None
    for d in range(levels, -1, -1):
        at = F.col("depth") == d
        own = styles.where(at).select("host", "node", "style", "n", F.explode_outer("kids").alias("kid"))
        if below is None:
            own = own.withColumn("score", F.lit(None).cast("double")).withColumn("worst", F.lit(None).cast("double"))
        else:
            own = own.join(below.select("host", F.col("node").alias("kid"), "score", "worst"), ["host", "kid"], "left")
        one = lambda c: F.when(F.col("kid").isNotNull(), F.coalesce(c, F.lit(1.0)))  # noqa: E731 - a child that one page alone has is important
        shown = own.groupBy("host", "node", "style", "n").agg(F.avg(one("score")).alias("mean"), F.max(one("worst")).alias("top"))
        per = shown.join(elements.where(at), ["host", "node"]).groupBy("host", "node", "imp", "l", "m", "single").agg(F.sum(F.col("n") * F.coalesce("mean", "imp")).alias("total"), F.max(F.coalesce("top", F.lit(0.0))).alias("top"))
        rest = elements.where(at).join(per.select("host", "node"), ["host", "node"], "left_anti").select("host", "node", "imp", "l", "m", "single", F.lit(0.0).alias("total"), F.lit(0.0).alias("top"))
        fade = F.pow(F.lit(GAMMA), F.col("l"))
        score = (1 - fade) * (F.col("single") + F.col("total")) / F.col("m") + fade * F.col("imp")
        worst = F.greatest("top", F.when(F.col("single") > RARE * F.col("m"), 1.0).otherwise(0.0), score)
        made = per.unionByName(rest).select("host", "node", score.alias("score"), worst.alias("worst"))
        below = written(made.unionByName(leaf.where(at).select("host", "node", "score", "worst")), "level")
        done.append(below.where(F.col("worst") < THRESHOLD).select("host", "node"))
    bad = done[0]
    for x in done[1:]:
        bad = bad.unionByName(x)
    inner = parents.join(bad, ["host", "node"], "left_semi").select("host", F.col("kid").alias("node"))
    return bad.join(inner, ["host", "node"], "left_anti")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, text)`` of every page."""
    small_batches(pages)
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), "html")
    cut = written(noise(p.select("host", "html")), "noise")
    sites = cut.groupBy("host").agg(F.count("*").alias("n"))
    wide = sites.where(F.col("n") > BRANCHES).select(F.col("host").alias("site"))
    few = written(cut.join(wide, F.col("host") == F.col("site"), "left_anti").groupBy("host").agg(F.collect_list("node").alias("branches")), "branches").withColumnRenamed("host", "site")
    size = few.agg(F.sum(F.size("branches") * 8 + F.length("site"))).first()[0] or 0
    joined = p.join(F.broadcast(few) if size <= BROADCAST_BYTES else few, F.col("host") == F.col("site"), "left").select("page_id", "host", "html", "branches")
    if not wide.isEmpty():
        joined = joined.join(wide, F.col("host") == F.col("site"), "left_anti").unionByName(_own_branches(p.join(wide, F.col("host") == F.col("site"), "left_semi"), cut))

    def run(batches):
        for b in batches:
            texts = [None if source is None else clean_text(parse(source), bad) for source, bad in zip(b.column("html").to_pylist(), _sets(b.column("branches")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return joined.select("page_id", "html", "branches").mapInArrow(run, pages.select("page_id").schema.add("text", "string"))


def _own_branches(pages: DataFrame, cut: DataFrame) -> DataFrame:
    """``(page_id, host, html, branches)``: for pages of hosts with very many noise branches, those that the page itself has."""

    def keys(batches):
        for b in batches:
            for i, t in enumerate(b.column("html").to_pylist()):
                own = list({_signed(k) for k, *_ in walk(parse(t))})
                at = pa.array([i] * len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("host", "h1", "h2")), pa.array(own, pa.int64())], ["host", "h1", "h2", "node"])

    h = [F.xxhash64("html").alias("h1"), F.xxhash64(F.lit(1), "html").alias("h2")]
    hashed = pages.select("page_id", "host", "html", *h)
    distinct = hashed.where("html is not null").select("host", "h1", "h2", "html").dropDuplicates(["host", "h1", "h2"])
    has = distinct.mapInArrow(keys, "host string, h1 long, h2 long, node long").join(cut, ["host", "node"])
    lists = has.groupBy("host", "h1", "h2").agg(F.collect_list("node").alias("branches"))
    return hashed.join(lists, ["host", "h1", "h2"], "left").select("page_id", "host", "html", "branches")
