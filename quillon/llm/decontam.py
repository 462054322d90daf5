"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items.

Items and documents are sets of word n-grams ("shingles").  Shingles are ordered by how many
documents hold them, rarest first.  An item of s shingles that is contained to a share t in
some window of a document shares at least ``need = ceil(t * s)`` shingles with it, hence one
of its ``s - need + 1`` rarest: only these prefix shingles are joined.  Candidates then pass
a length bound (the document holds at least ``need`` item shingles) and a positional bound
(the shingles seen so near the hit can still reach ``need`` inside one item-sized window), and
the containment is counted exactly over every window of as many shingle positions as the item has.

The document side is only mapped: items are broadcast in slices of a checked size, however
large the benchmark is.  Nothing is shuffled but one row per distinct item shingle and task.

Defined results: null and empty texts match nothing; an item or document of fewer than n words
has one shingle of all its words, so a short item is found only in a document of just these words;
each row of ``docs`` counts by itself, also when repeated; columns other than ``doc_id`` and
``text`` are ignored, and :func:`clean` hands them on. Null ids are kept as they are. Texts and items are taken whole,
however long; shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches, strings

N, THRESHOLD = 5, 0.8
#: Characters of benchmark text that are broadcast at once; a larger benchmark takes several passes.
SLICE_CHARS = 32_000_000
_BITS = 20


@dataclass
class Items:
    """One slice of the benchmark: shingles of item i are ``sets[i]``, sorted."""

    ids: list
    sets: list[np.ndarray]
    width: list[int]
    every: np.ndarray


def _shingles(texts: list[str], n: int):
    for i, part in tk.blocks(pa.array(texts, pa.string())):
        h, _, _, per = tk.words(*tk.buffers(part))
        g, doc, pos = tk.ngrams(h, per, n)
        yield i, len(part), g >> np.uint64(8), doc, pos


def _read_items(rows: list, n: int) -> Items:
    ids, sets, width = [], [], []
    for i, k, g, doc, _ in _shingles([r[1] for r in rows], n):
        ends = np.searchsorted(doc, np.arange(k + 1))
        for j in range(k):
            own = g[ends[j] : ends[j + 1]]
            if len(own):
                ids.append(rows[i + j][0])
                sets.append(np.unique(own))
                width.append(len(own))
    every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    return Items(ids, sets, width, every)


def _member(sorted_values: np.ndarray):
    """A test of which hashes are among the given ones, and where: a bit table first, then binary search."""
    table = np.zeros(1 << _BITS, np.bool_)
    table[(sorted_values & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(table[(g & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        k = np.searchsorted(sorted_values, g[at])
        k[k == len(sorted_values)] = 0
        hit = sorted_values[k] == g[at]
        return at[hit], k[hit]

    return find


def _document_counts(docs: DataFrame, every, n: int) -> dict[int, int]:
    """How many documents hold each item shingle."""

    def count(batches):
        find = _member(every.value)
        total = np.zeros(len(every.value), np.int64)
        for b in batches:
            for _, part in tk.blocks(strings(b, "text")):
                h, _, _, per = tk.words(*tk.buffers(part))
                g, doc, _ = tk.ngrams(h, per, n)
                at, k = find(g >> np.uint64(8))
                if len(at):
                    pair = np.unique(np.stack([doc[at], k]), axis=1)
                    total += np.bincount(pair[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    found = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {r.k: r.n for r in found.toLocalIterator()}


def _prefixes(items: Items, counts: dict[int, int], threshold: float) -> tuple[np.ndarray, list[list[int]], list[int]]:
    df = np.zeros(len(items.every), np.int64)
    if counts:
        df[np.fromiter(counts.keys(), np.int64)] = np.fromiter(counts.values(), np.int64)
    need, owners = [], {}
    for i, s in enumerate(items.sets):
        need.append(max(1, math.ceil(threshold * len(s) - 1e-9)))
        order = s[np.lexsort((s, df[np.searchsorted(items.every, s)]))]
        for x in order[: len(s) - need[i] + 1].tolist():
            owners.setdefault(x, []).append(i)
    keys = np.array(sorted(owners), np.uint64)
    return keys, [owners[k] for k in keys.tolist()], need


def best_window(pos: np.ndarray, which: np.ndarray, width: int) -> int:
    """Most distinct values of ``which`` at positions that fit in one window of ``width`` positions."""
    best, lo, inside = 0, 0, {}
    for hi in range(len(pos)):
        inside[which[hi]] = inside.get(which[hi], 0) + 1
        while pos[hi] - pos[lo] >= width:
            inside[which[lo]] -= 1
            if not inside[which[lo]]:
                del inside[which[lo]]
            lo += 1
        best = max(best, len(inside))
    return best


def _matches(texts: pa.Array, items: Items, find, owners, need, n: int):
    """(row, item, distinct shingles in the best window) of every contained item."""
    for i, part in tk.blocks(texts):
        h, _, _, per = tk.words(*tk.buffers(part))
        g, doc, pos = tk.ngrams(h, per, n)
        g = g >> np.uint64(8)
        at, k = find(g)
        if not len(at):
            continue
        seen: dict[tuple[int, int], list[int]] = {}
        for a, d, o in zip(at.tolist(), doc[at].tolist(), k.tolist()):
            for item in owners[o]:
                seen.setdefault((d, item), []).append(a)
        ends = np.searchsorted(doc, np.arange(len(part) + 1))
        for (d, item), hits in seen.items():
            s, w = items.sets[item], items.width[item]
            if ends[d + 1] - ends[d] < need[item]:
                continue
            lo, hi = max(ends[d], hits[0] - w + 1), min(ends[d + 1], hits[-1] + w)
            where = np.searchsorted(s, g[lo:hi])
            where[where == len(s)] = 0
            ok = s[where] == g[lo:hi]
            if ok.sum() < need[item]:
                continue
            best = best_window(pos[lo:hi][ok], where[ok].tolist(), w)
            if best >= need[item]:
                yield i + d, item, best


def _slices(benchmark: DataFrame, n: int):
    bench = benchmark.select("item_id", "text").where("text is not null")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    k = max(1, math.ceil(chars / SLICE_CHARS))
    for j in range(k):
        part = bench if k == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == j)
        items = _read_items([tuple(r) for r in part.collect()], n)
        if items.ids:
            yield items


def _index(docs: DataFrame, items: Items, n: int, threshold: float):
    sc = docs.sparkSession.sparkContext
    counts = _document_counts(docs, sc.broadcast(items.every), n)
    return sc.broadcast((items, *_prefixes(items, counts, threshold)))


def contained(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, containment)`` of every document and item contained in it to at least ``threshold``."""
    small_batches(docs)
    schema = docs.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType).add("containment", "double")
    out = None
    for items in _slices(benchmark, n):
        index = _index(docs, items, n, threshold)

        def scan(batches, index=index):
            its, keys, owners, need = index.value
            find = _member(keys)
            for b in batches:
                found = list(_matches(strings(b, "text"), its, find, owners, need, n))
                rows = pa.array([r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), pa.array([its.ids[i] for _, i, _ in found], item_type), pa.array([c / len(its.sets[i]) for _, i, c in found], pa.float64())],
                    ["doc_id", "item_id", "containment"],
                )

        item_type = _arrow(benchmark.schema["item_id"].dataType)
        part = docs.select("doc_id", "text").mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is contained to ``threshold``."""
    small_batches(docs)
    for items in _slices(benchmark, n):
        index = _index(docs, items, n, threshold)

        def keep(batches, index=index):
            its, keys, owners, need = index.value
            find = _member(keys)
            for b in batches:
                mask = np.ones(b.num_rows, np.bool_)
                for r, _, _ in _matches(strings(b, "text"), its, find, owners, need, n):
                    mask[r] = False
                yield b.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


SQL = f"""
with w as (select doc_id, row_number() over () as r, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
bw as (select item_id, row_number() over () as q, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
dg as (select doc_id, r, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) as p, w from w where len(w) > 0),
d as (select doc_id, r, p, array_to_string(w[p : p + {N - 1}], ' ') as g from dg),
ig as (select item_id, q, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) as p, w from bw where len(w) > 0),
i as (select item_id, q, array_to_string(w[p : p + {N - 1}], ' ') as g from ig),
size as (select q, count(*) as width, count(distinct g) as s from i group by q),
hit as (select d.doc_id, d.r, d.p, d.g, x.item_id, x.q from d join (select distinct item_id, q, g from i) x using (g)),
win as (select a.doc_id, a.r, a.item_id, a.q, a.p, count(distinct b.g) as c, any_value(s) as s
        from hit a join hit b on a.r = b.r and a.q = b.q join size on size.q = a.q
        where b.p >= a.p and b.p < a.p + width group by all),
best as (select doc_id, r, item_id, q, max(c) as c, any_value(s) as s from win group by all)
select doc_id, item_id, c / s::double as containment from best where c >= ceil({THRESHOLD} * s - 1e-9)
"""
