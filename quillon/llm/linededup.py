"""Line dedup over the whole corpus: each line stays where it occurs first.

Two Bloom filters, for line hashes seen once and seen twice, are built from per-task parts.
A part lists the filter bits its lines set, and those set by more than one of its lines; parts
merge by addition, so a bit set in two parts is a twice-seen bit.  A repeated line therefore
always has all its bits in the twice-seen filter: nothing is missed, and a false positive
costs one shuffled row of some 50 bytes.  Only these suspects are shuffled: their hash, a 128-bit BLAKE2b digest of the line, by which
they are confirmed, and their place.  A shared line's occurrences are combined on the map side before its first one is chosen.

Texts without a line to remove stay where they are: a Bloom filter of the rows that have one lets the others pass.  Texts that lose
lines are shuffled once, compressed, to meet the lines' numbers.

The filter has ``BITS_PER_LINE`` bits for each line counted, up to ``MAX_BITS`` (128 MiB to
broadcast).  Beyond that, from some 67 million lines on, more lines are suspected, in the end all: their digests move, never their text, and
the result is the same.

Defined results.  An occurrence is (doc_id, line number); the first is the lowest, null ids
last.  Every row that holds the first occurrence keeps it: rows that repeat the same id and
text are the same occurrence and keep the same lines.  Blank lines always stay.  A null
text stays null, an empty one empty; a document whose lines all occur before gets the empty text
(``drop_emptied`` removes it instead).  Texts are taken whole, however long, and so are lines.  All other columns are handed on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import free_name, small_batches, strings, written
from .filters import row_hash, split

BITS_PER_LINE, MAX_BITS, HASHES = 16, 1 << 30, 2
_SEGMENT = 20


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """The positions that each hash sets, one row per hash function."""
    m = np.uint64(size - 1)
    return np.stack([h & m, (h >> np.uint64(32)) & m])


def _filter(docs: DataFrame) -> tuple[object, int]:
    """The twice-seen filter, broadcast, and its size in bits."""
    n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    size = min(MAX_BITS, max(1 << _SEGMENT, 1 << int(BITS_PER_LINE * n).bit_length()))

    def part(batches):
        some, kept = [], []
        for b in batches:
            for _, t in tk.blocks(strings(b, "text")):
                some.append(tk.lines(*tk.buffers(t))[0])
            if sum(map(len, some)) > 4_000_000:
                kept.append(_positions(some, size))
                some = []
        kept.append(_positions(some, size))
        for once, twice in kept:
            for s in np.unique(once >> _SEGMENT).tolist():
                cut = [x[np.searchsorted(x, s << _SEGMENT) : np.searchsorted(x, (s + 1) << _SEGMENT)] - (s << _SEGMENT) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([c.astype(np.uint32).tobytes()], pa.binary()) for c in cut)], ["segment", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(1 << _SEGMENT, np.bool_), np.zeros(1 << _SEGMENT, np.bool_)
        for b in parts:
            for once, more in zip(b.column("once"), b.column("twice")):
                p = np.frombuffer(once.as_buffer(), np.uint32)
                twice[p[seen[p]]] = True
                seen[p] = True
                twice[np.frombuffer(more.as_buffer(), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

    parts = docs.select("text").mapInArrow(part, "segment int, once binary, twice binary")
    bits = np.zeros(size >> 3, np.uint8)
    width = 1 << (_SEGMENT - 3)
    for r in parts.groupBy("segment").applyInArrow(merge, "segment int, bits binary").toLocalIterator():
        bits[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bits), size


def _positions(hashes: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits set by the lines, and those set by more than one line (repeats of one line included)."""
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    own = _bits(h, size)
    own[1][own[0] == own[1]] ^= np.uint64(1)  # two bits for every line
    pos, count = np.unique(own.reshape(-1), return_counts=True)
    return pos.astype(np.int64), pos[count > 1].astype(np.int64)


def _suspected(h: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    own = _bits(h, size)
    own[1][own[0] == own[1]] ^= np.uint64(1)
    own = own.astype(np.int64)
    test = lambda p: (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
    return np.flatnonzero(test(own[0]) & test(own[1]))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, lines)``: the numbers, from 0, of the lines that occur before, for documents that have any; print is the row's hash."""
    small_batches(docs)
    twice, size = _filter(docs)

    def suspects(batches):
        bits = twice.value
        for b in batches:
            for i, t in tk.blocks(strings(b, "text")):
                raw, off = tk.buffers(t)
                h, start, end, doc, number = tk.lines(raw, off)
                at = _suspected(h, bits, size)
                data = memoryview(raw.tobytes())
                digests = np.frombuffer(b"".join(hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(start[at].tolist(), end[at].tolist())), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *(b.column(c).take(pa.array(doc[at] + i)) for c in ("doc_id", "print")), pa.array(number[at].astype(np.int32))],
                    ["h", "d1", "d2", "doc_id", "print", "number"],
                )

    long = T.LongType()
    schema = T.StructType([*(T.StructField(c, long) for c in ("h", "d1", "d2")), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("print", long), T.StructField("number", T.IntegerType())])
    found = written(docs.select("doc_id", "text", row_hash().alias("print")).mapInArrow(suspects, schema), "suspects")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")
    first = found.groupBy("h", "d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["h", "d1", "d2"]).where(~place.eqNullSafe(F.col("first")))
    return written(later.groupBy("doc_id", "print").agg(F.collect_set("number").alias("lines")), "lines")


def dedup_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with every line that occurs before taken out of ``text``."""
    gone, key, mark = free_name(docs, "gone"), free_name(docs, "gone_id"), free_name(docs, "gone_print")
    drop = repeated_lines(docs)
    names = docs.columns

    def squeeze(b):
        pack = zstandard.ZstdCompressor(level=3).compress
        texts = pa.array([None if x is None else pack(x.encode("utf-8", "surrogatepass")) for x in b.column("text").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([texts if c == "text" else b.column(c) for c in b.schema.names], b.schema.names)

    packed = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema])
    rest, moved, name = split(docs, drop.select(F.col("print").alias("h")), squeeze, packed)
    drop = drop.withColumnsRenamed({"lines": gone, "doc_id": key, "print": mark})

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = [x if x is None else unpack(x).decode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()]
            keep = np.ones(b.num_rows, np.bool_)
            for i, lines in enumerate(b.column(gone).to_pylist()):
                if texts[i] is None or lines is None:
                    continue
                out = set(lines)
                left = [x for k, x in enumerate(texts[i].split("\n")) if k not in out]
                texts[i] = "\n".join(left)
                keep[i] = any(x.strip(" \t\r") for x in left)
            done = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)
            yield done.filter(pa.array(keep)) if drop_emptied else done

    same = (moved[name] == drop[mark]) & moved["doc_id"].eqNullSafe(drop[key])
    changed = moved.join(drop, same, "left").select(*(moved[c] for c in names), gone).mapInArrow(cut, docs.schema)
    return rest.unionByName(changed)


SQL = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as number, r
           from (select *, row_number() over () as r from documents) where text is not null),
f as (select *, case when trim(line, ' ' || chr(9) || chr(13)) = '' then true
                else row(doc_id is null, doc_id, number) = min(row(doc_id is null, doc_id, number)) over (partition by line) end as stays from l),
k as (select r, coalesce(string_agg(line, chr(10) order by number) filter (stays), '') as text from f group by r)
select d.doc_id, k.text from (select *, row_number() over () as r from documents) d left join k using (r)
"""
