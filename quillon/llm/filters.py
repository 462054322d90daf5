"""Bloom filters over 64-bit hashes, built by all executors and broadcast, and what they let stay where it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name

#: Bits for each key, up to MAX_BITS (128 MiB to broadcast); beyond that more rows are taken for members, and the result is the same.
BITS, MAX_BITS = 16, 1 << 30
_SEGMENT = 1 << 16


def _positions(h: np.ndarray, size: int) -> np.ndarray:
    m = np.uint64(size - 1)
    return np.stack([h & m, (h >> np.uint64(32)) & m]).astype(np.int64)


class Bloom:
    """The set of the hashes in the long column ``h`` of ``keys``, with false positives."""

    def __init__(self, keys: DataFrame, n: int, max_bits: int = 0):
        self.size = size = min(max_bits or MAX_BITS, max(_SEGMENT, 1 << int(BITS * n).bit_length()))

        def part(batches):
            found = [np.unique(_positions(b.column("h").to_numpy().view(np.uint64), size)) for b in batches]
            p = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            for s in np.unique(p // _SEGMENT).tolist():
                own = p[np.searchsorted(p, s * _SEGMENT) : np.searchsorted(p, (s + 1) * _SEGMENT)] % _SEGMENT
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([own.astype("<u2").tobytes()], pa.binary())], ["s", "p"])

        def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = np.zeros(_SEGMENT, np.bool_)
            for b in parts:
                for x in b.column("p"):
                    on[np.frombuffer(x.as_buffer(), "<u2")] = True
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(on).tobytes()], pa.binary())], ["s", "p"])

        bits = np.zeros(size // 8, np.uint8)
        if n:
            for r in keys.mapInArrow(part, "s long, p binary").groupBy("s").applyInArrow(merge, "s long, p binary").toLocalIterator():
                bits[r.s * _SEGMENT // 8 : (r.s + 1) * _SEGMENT // 8] = np.frombuffer(r.p, np.uint8)
        self.bits = keys.sparkSession.sparkContext.broadcast(bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        on = self.bits.value
        a, b = _positions(h, self.size)
        test = lambda p: (on[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
        return (test(a) & test(b)).astype(np.bool_)


def row_hash(id_: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(id_, text)


def split(docs: DataFrame, keys: DataFrame, change=None, schema: StructType | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(rows that have none of ``keys``, rows that may have one, name of the column with their :func:`row_hash`).

    ``keys`` has the hashes in ``h``, one row each.  The first part is read, filtered and passed on where it is; only the second, which has a
    column more, has to be shuffled: ``change`` makes each of its batches smaller first, in the same Python worker, with columns of ``schema``.
    """
    bloom = Bloom(keys, keys.count())
    name = free_name(docs, "row_hash")
    hashed = docs.withColumn(name, row_hash())

    def take(inside):
        def run(batches):
            for b in batches:
                m = bloom.holds(b.column(name).to_numpy().view(np.uint64)) == inside
                if m.any():
                    part = b if m.all() else b.filter(pa.array(m))
                    yield part.drop_columns([name]) if not inside else part if change is None else change(part)

        return run

    moved = StructType([*(docs.schema if schema is None else schema).fields, hashed.schema[name]])
    return hashed.mapInArrow(take(False), docs.schema), hashed.mapInArrow(take(True), moved), name
