"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word ``N``-grams, hashed to 56 bits.  Two documents are linked if their sets have a Jaccard similarity
of ``THRESHOLD`` t or more; a class is what links connect.  All links are found; none is sampled, and no partners are capped.

1. Sets.  Documents with the same set are one set with a weight (they are linked to each other).
2. Order.  The hash range of n-grams is cut into fragments.  A fragment has every occurrence of its n-grams, so it counts in how many
   sets each one is, and hands those in two sets or more back to their sets.  n-grams of one set alone are never part of an overlap: a set
   x with fewer than t |x| others has no partner and goes no further.  The global order is by frequency, rarest first.
3. Candidates.  A set has ``KEYS`` min-wise keys, each the least hash of its shared n-grams; sets with a key in common are a cell.  Near
   copies nearly always meet there.  Pairs that don't are found by the exact prefix filter: similar sets have one of their
   |x| - ceil(t |x|) + 1 rarest n-grams in common.  Each prefix n-gram compares only the sets that have no key in common.
4. Counting.  The sets of a cell are cut at the bounds of ``V`` fragments of the order; each (cell, fragment) counts partial overlaps, and these
   are summed per pair.  A pair belongs to the first of its cells.  What leaves a cell is each set's links and one edge to its
   lowest partner, not the pairs.
5. Classes are the connected components of these edges.

Scale and skew.  Texts are read twice; n-grams move once, in packed blobs, and those of several sets once more.  n-grams that are in more than
a thousandth of all documents (a line that a third of them share) are counted where they are read, and don't go to a fragment.  A cell or
prefix n-gram of more than ``TILE`` sets is cut into pairs of tiles by a shuffle key, before anything is compared.  Work is
quadratic in the different texts of a group of near copies, as counting all links is; rows aren't.

Defined results: one row for each (doc_id, set of n-grams), so a doc_id that has two texts has two; rows equal in both are one document; null doc_ids
take no part; a null text, or one without a word, is a class of its own without links; a text of fewer than N words has one n-gram of all its words.
Texts are taken whole, however long.  class_id is the class's lowest doc_id; links counts the other documents that are linked to this one. Other columns
are ignored; :func:`keep_one` hands them on.  Sets are told apart by 64-bit hashes and n-grams by 56-bit ones; a collision, expected once
for some 10^9 different sets, would merge two of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import remove, small_batches, strings, written
from .filters import row_hash, split

N, THRESHOLD, KEYS, V, TILE = 3, 0.5, 4, 4, 1024
#: n-grams in a fragment (a task takes about 50 bytes of memory for each), in a block of the map side, and of prefixes in a fragment of candidates.
FRAGMENT, BLOCK, PREFIXES = 3_000_000, 1_500_000, 2_000_000
#: n-grams of a cell in one fragment, beyond which cells get more fragments than V.
CELL = 1_000_000
#: Edges that are few enough for the driver: 16 MB.
EDGES = 1_000_000
#: An n-gram is counted on the map side if some block has it so many times, and in all more than 1 / HOT of the documents do.
SEEN, HOT = 16, 1000
_KEYS = [f"key{q}" for q in range(KEYS)]


def _sets(texts: pa.Array, n: int):
    """(first row, rows, hashes in order, bounds by row, signature by row) of each block."""
    for i, part in tk.blocks(texts):
        h, _, _, per = tk.words(*tk.buffers(part))
        g, doc, _ = tk.ngrams(h, per, n)
        g, doc = tk.unique_per_doc(g, doc)
        ends = np.searchsorted(doc, np.arange(len(part) + 1))
        total = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(tk.mix(g ^ np.uint64(0x5157)), out=total[1:])
        size = np.diff(ends)
        sig = tk.mix(total[ends[1:]] - total[ends[:-1]] + size.astype(np.uint64))
        yield i, len(part), g, ends, sig


def _pack(x: np.ndarray, width: int = 7) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data, width: int = 7) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


def _gather(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes of runs that begin at ``start`` and have ``count`` entries, one after another."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _range(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of a 56-bit hash: parts are equal ranges of the order."""
    return ((h >> np.uint64(24)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _home(sig: np.ndarray, parts: int) -> np.ndarray:
    return _range(sig >> np.uint64(8), parts)


def _code(count: np.ndarray) -> np.ndarray:
    """A frequency to a fourth of a power of two, in a byte; what the order is by."""
    return np.minimum(255, 4 * np.log2(np.maximum(count, 1))).astype(np.uint8)


def _blob(sig, size, count, grams, codes=None) -> bytes:
    return b"".join((np.array([len(sig), codes is not None], "<u8").tobytes(), sig.astype("<u8").tobytes(), size.astype("<u4").tobytes(), count.astype("<u4").tobytes(), _pack(grams), b"" if codes is None else codes.tobytes()))


def _read(data):
    n, coded = np.frombuffer(data, "<u8", 2).tolist()
    sig = np.frombuffer(data, "<u8", n, 16)
    size, count = np.frombuffer(data, "<u4", 2 * n, 16 + 8 * n).reshape(2, n).astype(np.int64)
    at, m = 16 + 16 * n, int(count.sum())
    return sig, size, count, _unpack(data[at : at + 7 * m]), np.frombuffer(data, np.uint8, m, at + 7 * m) if coded else None


def _width(df: DataFrame) -> int:
    """Partitions for work that is heavy for its bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def documents(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, print, sig, size)`` of every row, sig null without a word, and rows ``(hot)`` of n-grams frequent in a block of them."""

    names = ["doc_id", "print", "sig", "size", "hot"]

    def frequent(held, kind):
        g, k = np.unique(np.concatenate(held), return_counts=True)
        data = np.stack([g[k >= SEEN], k[k >= SEEN].astype(np.uint64)]).astype("<u8").tobytes()
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (kind, pa.int64(), pa.int64(), pa.int32())), pa.array([data], pa.binary())], names)

    def run(batches):
        held: list[np.ndarray] = []
        kind = None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for i, k, g, ends, sig in _sets(strings(b, "text"), n):
                held.append(g)
                size = np.diff(ends).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, k), b.column("print").slice(i, k), pa.array(sig.view(np.int64), mask=size == 0), pa.array(size), pa.nulls(k, pa.binary())], names)
                if sum(map(len, held)) >= BLOCK:
                    yield frequent(held, kind)
                    held = []
        if held:
            yield frequent(held, kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", row_hash().alias("print")).where("doc_id is not null")
    return written(rows.mapInArrow(run, f"doc_id {kind}, print long, sig long, size int, hot binary"), "sets")


def _hot(found: DataFrame, rows: int, grams: int):
    """(n-grams in order, their codes), broadcast: at most a million, whatever the corpus."""
    least = max(SEEN, rows // HOT, grams // 1_000_000)

    def spread(batches):
        for b in batches:
            for x in b.column("hot"):
                g, k = np.frombuffer(x.as_buffer(), "<u8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(k.astype(np.int64))], ["g", "n"])

    top = found.where("hot is not null").select("hot").mapInArrow(spread, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows_ = sorted((r.g, r.n) for r in top.toLocalIterator())
    g, k = (np.array([r[i] for r in rows_], np.int64) for i in (0, 1))
    return found.sparkSession.sparkContext.broadcast((g.astype(np.uint64), _code(k)))


def shared_ngrams(docs: DataFrame, n: int, threshold: float, hot, grams: int) -> DataFrame:
    """``(sig, size, prefix, grams, codes, key0..)`` of every set that has n-grams enough in common with others.

    grams are its shared n-grams, rarest first, of which the first ``prefix`` are the prefix; codes are their frequencies.
    """
    v = max(1, math.ceil(grams / FRAGMENT))

    def segments(batches):
        """Blobs of the n-grams of one fragment each, and of frequent ones, for the sets' home (numbered after the fragments)."""
        seen: set[int] = set()
        held: list[tuple] = []
        hot_g, hot_code = hot.value

        def blobs():
            sig, size, g = (np.concatenate(x) for x in zip(*held))
            doc = np.repeat(np.arange(len(sig)), size)
            part = _range(g, v)
            code = None
            if len(hot_g):
                at = np.minimum(np.searchsorted(hot_g, g), len(hot_g) - 1)
                known = hot_g[at] == g
                part[known] = v + _home(sig, v)[doc[known]]
                code = hot_code[at]
            order = np.argsort(part.astype(np.int32), kind="stable")
            part, doc, g = part[order], doc[order], g[order]
            code = code[order] if code is not None else None
            run = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])))
            count = np.diff(np.append(run, len(g)))
            cut = np.flatnonzero(np.append(True, part[run][1:] != part[run][:-1]))
            for a, z in zip(cut.tolist(), np.append(cut[1:], len(run)).tolist()):
                p, lo, hi = int(part[run[a]]), int(run[a]), int(run[z - 1] + count[z - 1])
                d = doc[run[a:z]]
                yield p, _blob(sig[d], size[d], count[a:z], g[lo:hi], code[lo:hi] if p >= v else None)

        def flush():
            out = list(blobs())
            for i in range(0, len(out), 16):
                p, data = zip(*out[i : i + 16])
                p = np.array(p)
                yield pa.RecordBatch.from_arrays([pa.array((p % v).astype(np.int32)), pa.array(np.maximum(p - v, -1).astype(np.int32)), pa.array(data, pa.binary())], ["part", "home", "data"])

        for b in batches:
            for _, _, g, ends, sig in _sets(strings(b, "text"), n):
                own = [r for r, (s, k) in enumerate(zip(sig.tolist(), np.diff(ends).tolist())) if k and not (s in seen or seen.add(s))]
                if len(seen) > 200_000:  # only saves sending a copy twice
                    seen.clear()
                own = np.array(own, np.int64)
                size = np.diff(ends)[own]
                held.append((sig[own], size, g[_gather(ends[:-1][own], size)]))
            if sum(len(x[2]) for x in held) >= BLOCK:
                yield from flush()
                held = []
        if sum(len(x[2]) for x in held):
            yield from flush()

    def fragment(batches):
        """Of the n-grams of a fragment those that two sets have, with their frequency, for the sets' homes."""
        runs = []
        for b in batches:
            for home, data in zip(b.column("home").to_pylist(), b.column("data")):
                if home >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([data.as_py()], pa.binary())], ["home", "data"])
                else:
                    runs.append(_read(data.as_buffer())[:4])
        if not runs:
            return
        sig, size, count, g = (np.concatenate(x) for x in zip(*runs))
        runs.clear()
        _, first = np.unique(sig, return_index=True)  # a copy of a set, from another task, brings the same run
        if len(first) < len(sig):
            first.sort()
            g = g[_gather((np.cumsum(count) - count)[first], count[first])]
            sig, size, count = sig[first], size[first], count[first]
        order = np.argsort(g)
        s = g[order]
        df = np.diff(np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s)))
        code = np.zeros(len(g), np.uint8)
        code[order] = np.repeat(np.where(df > 1, np.maximum(_code(df), 1), 0).astype(np.uint8), df)
        del order, s, df
        keep = code > 0
        owner = np.repeat(np.arange(len(sig)), count)[keep]
        g, code = g[keep], code[keep]
        count = np.bincount(owner, minlength=len(sig))
        home = _home(sig, v)
        by = np.argsort(home, kind="stable")
        by = by[count[by] > 0]
        at = _gather((np.cumsum(count) - count)[by], count[by])
        g, code, sig, size, count, home = g[at], code[at], sig[by], size[by], count[by], home[by]
        ends = np.append(0, np.cumsum(count))
        cut = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else []
        for a, z in zip(list(cut), [*cut[1:], len(home)]):
            yield pa.RecordBatch.from_arrays([pa.array([int(home[a])], pa.int32()), pa.array([_blob(sig[a:z], size[a:z], count[a:z], g[ends[a] : ends[z]], code[ends[a] : ends[z]])], pa.binary())], ["home", "data"])

    def ranked(batches):
        runs = [_read(x.as_buffer()) for b in batches for x in b.column("data")]
        if not runs:
            return
        sig, size, count, g, code = (np.concatenate(x) for x in zip(*runs))
        runs.clear()
        ids, first, sid = np.unique(sig, return_index=True, return_inverse=True)
        size = size[first]
        owner = np.repeat(sid, count)
        order = np.lexsort((g, code, owner))
        g, code, owner = g[order], code[order], owner[order]
        new = np.append(True, (g[1:] != g[:-1]) | (owner[1:] != owner[:-1]))  # frequent n-grams of a copied set came from several tasks
        g, code, owner = g[new], code[new], owner[new]
        shared = np.bincount(owner, minlength=len(ids))
        need = np.ceil(threshold * size - 1e-9).astype(np.int64)
        start = np.cumsum(shared) - shared
        keys = [np.minimum.reduceat(tk.mix(g * np.uint64(2 * q + 3) + np.uint64(q + 1)), start) for q in range(KEYS)]
        alive = np.flatnonzero(shared >= np.maximum(need, 1))
        for i in range(0, len(alive), 256):
            own = alive[i : i + 256]
            some = [slice(a, a + k) for a, k in zip(start[own].tolist(), shared[own].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[own].view(np.int64)), pa.array(size[own].astype(np.int32)), pa.array((shared - need + 1)[own].astype(np.int32)), pa.array([_pack(g[s]) for s in some], pa.binary()), pa.array([code[s].tobytes() for s in some], pa.binary()), *(pa.array(k[own].view(np.int64)) for k in keys)],
                ["sig", "size", "prefix", "grams", "codes", *_KEYS],
            )

    text = docs.where("doc_id is not null and text is not null").select("text")
    sent = text.mapInArrow(segments, "part int, home int, data binary").repartitionById(v, "part")
    back = sent.mapInArrow(fragment, "home int, data binary").repartitionById(v, "home")
    return written(back.mapInArrow(ranked, "sig long, size int, prefix int, grams binary, codes binary, " + ", ".join(f"{k} long" for k in _KEYS)), "shared")


def _objects(blobs: pa.Array) -> np.ndarray:
    out = np.empty(len(blobs), object)
    for i, x in enumerate(blobs):
        out[i] = x.as_buffer()
    return out


def _chunks(batches, by: list[str]):
    """(columns as arrays, bounds of the groups, with the end) of sorted rows, whole groups at a time; a group ends where one of ``by`` changes."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        own = {c: _objects(b.column(c)) if pa.types.is_binary(b.schema.field(c).type) else b.column(c).to_numpy() for c in b.schema.names}
        if rest is not None:
            own = {c: np.concatenate((rest[c], x)) for c, x in own.items()}
        new = np.zeros(len(own[by[0]]), np.bool_)
        new[0] = True
        for c in by:
            new[1:] |= own[c][1:] != own[c][:-1]
        bounds = np.flatnonzero(new)
        last = int(bounds[-1])
        rest = {c: x[last:] for c, x in own.items()}
        if last:
            yield {c: x[:last] for c, x in own.items()}, bounds.tolist()
    if rest is not None:
        yield rest, [0, len(rest[by[0]])]


def _eligible(x: dict, a: int, z: int, threshold: float):
    """Index pairs (i, j), i < j, that the cell of rows a..z has to count: of similar sizes, and in no cell before.

    The cell's kind is the number of the key its sets have in common, or -1: what its ``center`` has a prefix n-gram, but no key, in common with.
    """
    kind, size = int(x["kind"][a]), x["size"][a:z].astype(np.int64)
    if kind < 0:
        c = int(np.flatnonzero(x["sig"][a:z] == x["center"][a])[0])
        j = np.delete(np.arange(z - a), c)
        return np.minimum(c, j), np.maximum(c, j)
    tile, other = x["tile"][a:z], x["other"][a:z]
    out, all_ = [], np.arange(z - a)
    for lo in range(0, z - a, 256):
        s = slice(lo, min(lo + 256, z - a))
        ok = (np.minimum(size[s, None], size[None]) >= threshold * np.maximum(size[s, None], size[None]) - 1e-9) & (all_[s, None] < all_[None]) & (other[s, None] == tile[None])
        for q in range(kind):
            k = x[_KEYS[q]][a:z]
            ok &= k[s, None] != k[None]
        i, j = np.nonzero(ok)
        out.append((i + lo, j))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


_CELL = "cell long, kind int, center long, tile int, other int, sig long, size int"
_LIGHT = _CELL + ", " + ", ".join(f"{k} long" for k in _KEYS)
_names = lambda schema: [c.split()[0] for c in schema.split(", ")]


def key_cells(sets: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``_CELL``: the cells of sets with a key in common, and of their sets those that have a pair to count there."""
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("kind"), F.xxhash64(F.lit(q), F.col(k)).alias("cell")) for q, k in enumerate(_KEYS)))).alias("c")
    rows = sets.select(each, "sig", "size", *_KEYS).select("c.*", "sig", "size", *_KEYS)
    counts = rows.groupBy("cell").count().where("count > 1").select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64(F.lit("tile"), "sig"), F.col("tiles")).cast("int")
    rows = rows.join(counts, "cell").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cell = F.when(F.col("tiles") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("tile", "other"), F.greatest("tile", "other")))
    rows = rows.select(cell.alias("cell"), "kind", F.lit(0).cast("long").alias("center"), "tile", "other", "sig", "size", *_KEYS)

    def needed(batches):
        for x, bounds in _chunks(batches, ["cell"]):
            keep = [np.zeros(0, np.int64)]
            for a, z in zip(bounds, bounds[1:]):
                if z - a > 1:
                    i, j = _eligible(x, a, z, threshold)
                    keep.append(a + np.unique(np.concatenate((i, j))))
            at = np.concatenate(keep)
            yield pa.RecordBatch.from_arrays([pa.array(x[c][at]) for c in _names(_CELL)], _names(_CELL))

    return rows.repartition(_width(sets), "cell").sortWithinPartitions("cell", "sig").mapInArrow(needed, _CELL)


def _apart(group, sig, size, keys, threshold: float, tile=None, other=None):
    """Chunks of (sig, sig), lower first, of rows of one group that have no key in common; rows are sorted by group and first key."""
    new = np.append(True, group[1:] != group[:-1])
    ends = np.append(np.flatnonzero(new)[1:], len(group))[np.cumsum(new) - 1]
    new |= np.append(True, keys[0][1:] != keys[0][:-1])
    after = np.append(np.flatnonzero(new)[1:], len(group))[np.cumsum(new) - 1]
    count = ends - after
    upto = np.cumsum(count)
    lo = 0
    while lo < len(group):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 2_000_000, "right")))
        i, j = np.repeat(np.arange(lo, hi), count[lo:hi]), _gather(after[lo:hi], count[lo:hi])
        ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        if tile is not None:
            ok &= other[i] == tile[j]
        for k in keys[1:]:
            ok &= k[i] != k[j]
        i, j = i[ok], j[ok]
        if len(i):
            yield np.unique(np.stack([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])]), axis=1)
        lo = hi


_PAIR = "a long, b long"


def _pair_batch(p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``, distinct: sets that have an n-gram of their prefixes, but no key, in common."""
    total = sets.agg(F.sum("prefix")).first()[0] or 0
    parts = max(1, math.ceil(total / PREFIXES))
    most = int(_code(np.array([TILE]))[0])

    def entries(b):
        prefix = b.column("prefix").to_numpy().astype(np.int64)
        g = np.concatenate([_unpack(x.as_buffer()[: 7 * k]) for x, k in zip(b.column("grams"), prefix.tolist())])
        code = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8, k) for x, k in zip(b.column("codes"), prefix.tolist())])
        return g, code, np.repeat(np.arange(len(prefix)), prefix)

    def offered(batches):
        for b in batches:
            if not b.num_rows:
                continue
            g, code, row = entries(b)
            g, row = g[code <= most], row[code <= most]
            sig, size = b.column("sig").to_numpy().view(np.uint64), b.column("size").to_numpy()
            keys = np.stack([b.column(k).to_numpy() for k in _KEYS])
            part = _range(g, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.unique(part).tolist():
                own = order[cuts[p] : cuts[p + 1]]
                r, count = np.unique(row[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_blob(sig[r], size[r], count, g[own])], pa.binary()), pa.array([keys[:, r].tobytes()], pa.binary())], ["part", "data", "keys"])

    def met(batches):
        runs, keys = [], []
        for b in batches:
            for data, k in zip(b.column("data"), b.column("keys")):
                runs.append(_read(data.as_buffer())[:4])
                keys.append(np.frombuffer(k.as_buffer(), np.int64).reshape(KEYS, -1))
        if not runs:
            return
        sig, size, count, g = (np.concatenate(x) for x in zip(*runs))
        k = np.concatenate(keys, axis=1)
        owner = np.repeat(np.arange(len(sig)), count)
        order = np.argsort(g)
        s = g[order]
        alone = np.append(True, s[1:] != s[:-1])
        alone &= np.append(alone[1:], True)
        own = owner[order[~alone]]
        again = np.lexsort((k[0][own], s[~alone]))
        own = own[again]
        for p in _apart(s[~alone][again], sig.view(np.int64)[own], size[own], k[:, own], threshold):
            yield _pair_batch(p)

    def frequent(batches):
        for b in batches:
            if not b.num_rows:
                continue
            g, code, row = entries(b)
            g, code, row = g[code > most], code[code > most], row[code > most]
            tiles = np.ceil(2 ** ((code.astype(np.int64) + 1) / 4) / TILE).astype(np.int64)
            sig = b.column("sig").to_numpy()
            tile = (tk.mix(sig.view(np.uint64))[row] % tiles.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(g)), tiles)
            other = _gather(np.zeros(len(g), np.int64), tiles)
            cell = tk.mix(tk.mix(g[at]) ^ (np.minimum(tile[at], other) * (1 << 31) + np.maximum(tile[at], other)).astype(np.uint64))
            r = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(tile[at].astype(np.int32)), pa.array(other.astype(np.int32)), *(b.column(c).take(r) for c in ("sig", "size", *_KEYS))], ["cell", "tile", "other", "sig", "size", *_KEYS])

    def compared(batches):
        for x, _ in _chunks(batches, ["cell"]):
            keys = np.stack([x[k] for k in _KEYS])
            for p in _apart(x["cell"], x["sig"], x["size"].astype(np.int64), keys, threshold, x["tile"], x["other"]):
                yield _pair_batch(p)

    few = sets.mapInArrow(offered, "part int, data binary, keys binary").repartitionById(parts, "part").mapInArrow(met, _PAIR)
    many = sets.mapInArrow(frequent, "cell long, tile int, other int, sig long, size int, " + ", ".join(f"{k} long" for k in _KEYS))
    many = many.repartition(_width(sets), "cell").sortWithinPartitions("cell", _KEYS[0]).mapInArrow(compared, _PAIR)
    return few.unionByName(many).distinct()


def stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``_CELL``: a cell for each set and TILE of its partners among ``pairs``."""
    tiles = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / TILE).alias("tiles"))
    cell = F.xxhash64(F.lit(-1), "a", F.pmod(F.xxhash64(F.lit("tile"), "b"), F.col("tiles"))).alias("cell")
    found = pairs.join(tiles, "a").select(cell, "a", "b")
    own = found.select("cell", F.col("a").alias("center"), F.col("a").alias("sig")).distinct().unionByName(found.select("cell", F.col("a").alias("center"), F.col("b").alias("sig")))
    return own.join(sets.select("sig", "size"), "sig").select("cell", F.lit(-1).alias("kind"), "center", F.lit(0).alias("tile"), F.lit(0).alias("other"), "sig", "size")


def overlaps(grams: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common n-grams of the pairs (i, j) of sets, by blocks of a matrix product."""
    d = len(grams)
    if d == 2:
        both = np.sort(np.concatenate(grams))
        return np.array([np.count_nonzero(both[1:] == both[:-1])] * len(i), np.int64)
    token, doc = np.concatenate(grams), np.repeat(np.arange(d), [len(g) for g in grams])
    _, column, n = np.unique(token, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    doc, column = doc[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max(initial=-1)) + 1
    out = np.zeros(len(i), np.int64)
    order = np.argsort(i, kind="stable")
    for c in range(0, width, 4096):  # columns, then rows, so that no matrix is large
        inside = (column >= c) & (column < c + 4096)
        m = np.zeros((d, min(4096, width - c)), np.float32)
        m[doc[inside], column[inside] - c] = 1
        for r in range(0, d, 512):
            own = order[slice(*np.searchsorted(i[order], (r, r + 512)))]
            if len(own):
                out[own] += (m[r : r + 512] @ m.T)[i[own] - r, j[own]].astype(np.int64)
    return out


def _lowest(d: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of d nodes the lowest that edges connect it with."""
    low = np.arange(d)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def links(cells: DataFrame, sets: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """``(sig, links, low)``: of each cell's sets that have a partner there their partners' documents, and the lowest set they connect with."""
    largest = cells.groupBy("cell").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    v = max(V, math.ceil(largest / CELL))
    rows = cells.drop("size").join(weights.select("sig", F.col("n").alias("weight")), "sig").join(sets.select("sig", "size", *_KEYS, "grams"), "sig")
    info = [c for c in _names(_LIGHT) if c != "cell"] + ["weight"]
    kinds = [np.dtype("<i8")] * len(info)

    def cut(batches):
        bounds = np.arange(v + 1)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                data = []
                for x in part.column("grams"):
                    g = np.sort(_unpack(x.as_buffer()))
                    at = np.searchsorted(_range(g, v), bounds).tolist()
                    data += [_pack(g[at[k] : at[k + 1]]) for k in range(v)]
                take = pa.array(np.repeat(np.arange(part.num_rows), v))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(v, dtype=np.int32), part.num_rows)), *(part.column(c).take(take) for c in ("cell", *info)), pa.array(data, pa.binary())], ["v", "cell", *info, "data"])

    def partial(batches):
        for x, bounds in _chunks(batches, ["cell", "v"]):
            out = []
            for a, z in zip(bounds, bounds[1:]):
                i, j = _eligible(x, a, z, threshold)
                if len(i):
                    c = overlaps([_unpack(g) for g in x["data"][a:z]], i, j)
                    members = b"".join(x[k][a:z].astype(t).tobytes() for k, t in zip(info, kinds)) if x["v"][a] == 0 else b""
                    out.append((int(x["cell"][a]), int(x["v"][a]), c.astype("<u4").tobytes(), members))
                if len(out) >= 64 or z == len(x["cell"]) and out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["cell", "v", "counts", "members"])
                    out = []

    def summed(batches):
        for x, bounds in _chunks(batches, ["cell"]):
            done = []
            for a, z in zip(bounds, bounds[1:]):
                m = np.frombuffer(x["members"][a], "<i8").reshape(len(info), -1)
                own = dict(zip(info, m))
                i, j = _eligible(own, 0, m.shape[1], threshold)
                common = np.zeros(len(i), np.int64)
                for c in x["counts"][a:z]:
                    common += np.frombuffer(c, "<u4")
                near = common / (own["size"][i] + own["size"][j] - common) >= threshold - 1e-12
                i, j = i[near], j[near]
                if len(i):
                    w = own["weight"]
                    n = np.bincount(i, w[j], m.shape[1]) + np.bincount(j, w[i], m.shape[1])
                    some = np.flatnonzero(n)
                    done.append(np.stack([own["sig"][some], n[some].astype(np.int64), own["sig"][_lowest(m.shape[1], i, j)[some]]]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(done, axis=1)], ["sig", "links", "low"])

    p = _width(sets)
    segments = rows.select("cell", *info, "grams").mapInArrow(cut, f"v int, {_LIGHT}, weight long, data binary")
    parts = segments.repartition(p, "cell", "v").sortWithinPartitions("cell", "v", "sig").mapInArrow(partial, "cell long, v int, counts binary, members binary")
    return parts.repartition(p, "cell").sortWithinPartitions("cell", "v").mapInArrow(summed, "sig long, links long, low long")


def groups(edges: DataFrame) -> DataFrame:
    """``(node, first)``: the lowest node of its connected component, for every node that has an edge and isn't that one.

    Alternating star contraction: each round hangs neighbours on the lowest of their neighbourhood, first the larger ones, then the smaller; the
    rounds needed grow with the logarithm of the longest path.  Each round is written to the shared folder, and the one before removed.  At most
    ``EDGES`` edges, counted first, are connected on the driver instead.
    """
    e = written(edges.where("a <> b").distinct(), "edges")
    if e.count() <= EDGES:
        t = e.toArrow()
        nodes, at = np.unique(np.concatenate([t.column(c).to_numpy() for c in ("a", "b")]).astype(np.int64), return_inverse=True)
        low = _lowest(len(nodes), *at.reshape(2, -1))
        some = np.flatnonzero(low < np.arange(len(nodes)))
        return e.sparkSession.createDataFrame(pa.table({"node": nodes[some], "first": nodes[low[some]]}))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("x"), F.col("low").alias("y")).where("x <> y").distinct()
        large = written(large, "large")
        small_low = large.groupBy("x").agg(F.min("y").alias("low"))
        s = large.join(small_low, "x")
        small = s.select(F.greatest("y", "low").alias("b"), F.least("y", "low").alias("a")).unionByName(s.select(F.col("x").alias("b"), F.col("low").alias("a"))).where("a <> b").distinct()
        done = written(small.select("a", "b"), "edges")
        remove(large)
        remove(e)
        e = done
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("first"))


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(:func:`documents`, ``(sig, n, first)`` of every set, ``(sig, links)`` and ``(node, first)`` of those that have near ones)."""
    small_batches(docs)
    found = documents(docs, n)
    rows, grams = found.where("sig is not null").agg(F.count("*"), F.sum("size")).first()
    hot = _hot(found, rows, grams or 0)
    sets = shared_ngrams(docs, n, threshold, hot, grams or 0)
    weights = found.where("sig is not null").select("sig", "doc_id").distinct().groupBy("sig").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    cells = written(key_cells(sets, threshold).unionByName(stars(written(prefix_pairs(sets, threshold), "pairs"), sets)), "cells")
    near = written(links(cells, sets, weights, threshold), "links")
    remove(cells)
    remove(sets)
    comps = groups(near.select(F.col("low").alias("a"), F.col("sig").alias("b")))
    return found, weights, near.groupBy("sig").agg(F.sum("links").alias("links")), comps


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, links)`` of every document."""
    found, weights, near, comps = linked(docs, n, threshold)
    info = weights.join(near, "sig", "left").join(comps.withColumnsRenamed({"node": "sig", "first": "root"}), "sig", "left")
    info = written(info.select("sig", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "first", F.coalesce("root", "sig").alias("root")), "classes")
    lowest = info.groupBy("root").agg(F.min("first").alias("class_id"))
    rows = found.where("doc_id is not null").select("doc_id", "sig").distinct()
    known = rows.where("sig is not null").join(info.join(lowest, "root").select("sig", "class_id", "links"), "sig").select("doc_id", "class_id", "links")
    return known.unionByName(rows.where("sig is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with one document of each class: the one of the lowest doc_id; of its rows equal in id and text, one.

    Rows of one doc_id whose texts differ are told apart.  Rows without doc_id, text or word stay.  Only rows that go, or stay once for
    several, are shuffled with their text; the rest stay where they are.
    """
    found, _, _, comps = linked(docs, n, threshold)
    rows = found.where("sig is not null").groupBy("doc_id", "print", "sig").agg(F.count("*").alias("n"))
    rows = written(rows.join(comps.withColumnsRenamed({"node": "sig", "first": "root"}), "sig", "left").select("doc_id", "print", "sig", "n", F.coalesce("root", "sig").alias("root")), "rows")
    place = F.struct("doc_id", "sig", "print")
    several = rows.groupBy("root").agg(F.min(place).alias("stays"), F.sum("n").alias("all")).where("all > 1").drop("all")
    marks = rows.join(several, "root").select(F.col("print").alias("h"), (place == F.col("stays")).alias("stays"), "n").where("not stays or n > 1")
    marks = written(marks.select("h", "stays"), "marks")
    rest, suspects, name = split(docs, marks)
    untouched = suspects.join(marks, suspects[name] == marks["h"], "left_anti").drop(name)
    once = suspects.join(marks.where("stays"), suspects[name] == marks["h"], "left_semi").dropDuplicates([name]).drop(name)
    return rest.unionByName(untouched).unionByName(once)


SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents where doc_id is not null),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) as p from w where len(w) > 0),
g as (select distinct doc_id, array_to_string(w[p : p + {N - 1}], ' ') as g from p),
s as (select doc_id, count(*) as n from g group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from o join s x on x.doc_id = a join s y on y.doc_id = b where o / (x.n + y.n - o)::double >= {THRESHOLD} - 1e-12),
r as (select doc_id as a, doc_id as b from w union select r.a, l.b from r join l on r.b = l.a)
select a as doc_id, min(b) as class_id, (select count(*) from l where l.a = r.a) as links from r group by a
"""
