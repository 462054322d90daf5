"""Sequence packing along a space-filling curve.

A document's hashed bag of words (square roots of counts in ``BUCKETS`` columns) is projected by fixed
random signs to ``DIMS`` numbers, which are scaled to the vector's length and quantised to ``CELL_BITS`` bits
each; their place on the Hilbert curve is the document's key.  Documents are range-sorted by key and laid
end to end, so a sequence of ``CAPACITY`` tokens holds neighbours on the curve; a document that doesn't fit
goes on in the next sequence.  No token is lost, repeated or padded; only the last sequence is short.

Text is mapped once to small rows (key, id, length), and only these are shuffled: a range partition sorts
them, each partition's tokens are totalled, and offsets are running sums within a partition plus the totals
before it.  The driver sees one number per partition.

Tokens are words as :mod:`textkernel` cuts them, and one end mark per document; or the integer column named
``tokens``.  Defined results: null and empty texts are documents of the end mark alone; negative or null lengths count as 0, and a
document of length 0 has no piece; ties on the key go by id (nulls first), length, and a hash of the text; rows equal in
all of these are laid side by side; texts are read whole, however long; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import free_name, small_batches, strings, written

BUCKETS, DIMS, CELL_BITS, CAPACITY = 4096, 3, 10, 2048
_SCALE = 1024

_signs = 1 - 2 * ((tk.mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(0x5EED))[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (Skilling's transform)."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(len(x)):
            on = (x[d] & q) > 0
            swap = (x[0] ^ x[d]) & p
            x[0], x[d] = np.where(on, x[0] ^ p, x[0] ^ swap), np.where(on, x[d], x[d] ^ swap) if d else np.where(on, x[0] ^ p, x[0] ^ swap)
        q >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    t = np.zeros(len(cells), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def cells(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Quantised projection of each document's hashed bag of words; exact integers up to the last division."""
    k = len(per) - 1
    doc = np.repeat(np.arange(k), np.diff(per))
    pair, count = np.unique(doc * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    weight = np.floor(np.sqrt(count) * _SCALE).astype(np.int64)
    own, column = pair // BUCKETS, pair % BUCKETS
    ends = np.searchsorted(own, np.arange(k + 1))
    total = np.zeros((len(pair) + 1, DIMS + 1), np.int64)
    np.cumsum(np.column_stack([weight[:, None] * _signs[column], weight * weight]), axis=0, out=total[1:])
    s = total[ends[1:]] - total[ends[:-1]]
    z = s[:, :DIMS] / np.sqrt(np.maximum(s[:, DIMS:], 1))  # about a standard normal, moved by the words common to a language
    z = z / (1 + np.abs(z) / 2)  # within -2..2
    return np.clip(np.floor((z + 2) / 4 * (1 << CELL_BITS)), 0, (1 << CELL_BITS) - 1).astype(np.int64)


def keyed(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """``(curve_key, doc_id, n_tokens, tie)`` of every document."""
    small_batches(docs)
    given = tokens is not None
    length = free_name(docs, "length_")
    source = docs.select("doc_id", "text", F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias(length)) if given else docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            for i, t in tk.blocks(strings(b, "text")):
                raw, off = tk.buffers(t)
                h, _, _, per = tk.words(raw, off)
                part = b.slice(i, len(t))
                n = part.column(2) if given else pa.array(np.diff(per) + 1)
                total = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * tk.powers(len(raw)), out=total[1:])
                tie = tk.mix((total[off[1:]] - total[off[:-1]]) * tk.powers(len(raw) + 1, True)[off[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(hilbert(cells(h, per), CELL_BITS)), part.column("doc_id"), n, pa.array(tie.view(np.int64))], ["curve_key", "doc_id", "n_tokens", "tie"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"curve_key long, doc_id {id_type}, n_tokens long, tie long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokens: str | None = None) -> DataFrame:
    """``(seq_id, seq_offset, doc_id, doc_offset, n_tokens)``: the pieces of every sequence, tokens ``doc_offset`` and on of a document at ``seq_offset``."""
    order = ["curve_key", "doc_id", "n_tokens", "tie"]
    rows = written(keyed(docs, tokens), "curve")
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranged")
    before, total = [], 0
    for r in ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row per partition
        before.append((r.part, total))
        total += r.n
    offsets = docs.sparkSession.createDataFrame(before, "part int, before long")
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = ranged.withColumn("upto", F.sum("n_tokens").over(here)).join(F.broadcast(offsets), "part").where("n_tokens > 0")
    laid = laid.select("doc_id", "n_tokens", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("s"))
    cap = F.lit(capacity)
    pieces = laid.select("*", F.explode(F.sequence(F.floor(F.col("s") / cap), F.floor((F.col("s") + F.col("n_tokens") - 1) / cap))).alias("seq_id"))
    start = F.greatest(F.col("s"), F.col("seq_id") * cap)
    end = F.least(F.col("s") + F.col("n_tokens"), (F.col("seq_id") + 1) * cap)
    return pieces.select("seq_id", (start - F.col("seq_id") * cap).cast("int").alias("seq_offset"), "doc_id", (start - F.col("s")).alias("doc_offset"), (end - start).cast("int").alias("n_tokens"))
