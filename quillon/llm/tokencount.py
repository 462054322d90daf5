"""Token counts by a two-tier lookup on the map side.

Tier one is an open-addressing hash table, broadcast: 64-bit hashes and BPE lengths of the ``TABLE`` most
frequent pre-tokens, looked up for a whole batch at once.  Tier two, for what misses it, is a
cache in each Python worker that encodes a pre-token when it is first met, and is emptied when it
holds ``CACHE`` entries.  Occurrences of pre-tokens are never shuffled.

Which pre-tokens are frequent is found over the whole corpus: each task counts all of its own
and reports the ``REPORT`` commonest, and these reports are summed.  The table decides speed only; the counts are
exact whatever it holds (up to a collision of 64-bit hashes).  It has a fixed size, about 1.2 MB.

Defined results: a null text has a null count, an empty one 0; repeated rows each count; a text, and a pre-token, is taken whole, however long; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textkernel as tk
from .common import small_batches, strings

TABLE, REPORT, CACHE = 1 << 16, 1 << 13, 1 << 20
_SLOTS = 1 << 18


def frequent(docs: DataFrame, size: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of all texts, by the tasks' reports."""

    def report(batches):
        total: dict[int, list] = {}
        for b in batches:
            for _, t in tk.blocks(strings(b, "text")):
                code, start, end, _ = bpe.pretokens(t.to_pylist())
                h, first, n = np.unique(bpe.hashes(code, start, end), return_index=True, return_counts=True)
                for x, f, c in zip(h.tolist(), first.tolist(), n.tolist()):
                    if x in total:
                        total[x][0] += c
                    else:
                        total[x] = [c, bpe.string(code, start[f], end[f])]
                if len(total) > 64 * REPORT:  # as many as a task keeps; what is dropped is rare
                    total = dict(sorted(total.items(), key=lambda kv: -kv[1][0])[: 16 * REPORT])
        top = sorted(total.values(), key=lambda v: -v[0])[:REPORT]
        yield pa.RecordBatch.from_arrays([pa.array([p for _, p in top], pa.string()), pa.array([c for c, _ in top], pa.int64())], ["piece", "n"])

    reports = docs.select("text").mapInArrow(report, "piece string, n long")
    return [r.piece for r in reports.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()]


def compact(pieces: list[str], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, lengths, longest probe) of an open-addressing table; key 0 is a free slot."""
    keys, values, probe = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint16), 0
    for p, n in zip(pieces, lengths):
        if n > 65535:
            continue
        c = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = int(bpe.hashes(c, np.array([0]), np.array([len(c)]))[0])
        k = 0
        while keys[(h + k) % _SLOTS] not in (0, h):
            k += 1
        keys[(h + k) % _SLOTS], values[(h + k) % _SLOTS] = h, n
        probe = max(probe, k)
    return keys, values, probe


def lookup(table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, found) of each hash."""
    keys, values, probe = table
    out, found = np.zeros(len(h), np.int64), np.zeros(len(h), np.bool_)
    left = np.arange(len(h))
    for k in range(probe + 1):
        slot = ((h[left] + np.uint64(k)) & np.uint64(_SLOTS - 1)).astype(np.int64)
        hit = keys[slot] == h[left]
        out[left[hit]], found[left[hit]] = values[slot[hit]], True
        left = left[~hit & (keys[slot] != 0)]
        if not len(left):
            break
    return out, found


_caches: dict[bytes, dict[int, int]] = {}  # by vocabulary


def count(texts: list[str], table, ranks: bytes) -> np.ndarray:
    """Tokens of each text."""
    code, start, end, doc = bpe.pretokens(texts)
    h = bpe.hashes(code, start, end)
    n, found = lookup(table, h)
    missed = np.flatnonzero(~found)
    if len(missed):
        cache = _caches.setdefault(ranks, {})
        encode = bpe.encoder(ranks).encode_ordinary
        keys, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
        lengths = []
        for x, f in zip(keys.tolist(), missed[first].tolist()):
            v = cache.get(x)
            if v is None:
                if len(cache) >= CACHE:
                    cache.clear()
                v = cache[x] = len(encode(bpe.string(code, start[f], end[f])))
            lengths.append(v)
        n[missed] = np.array(lengths, np.int64)[back]
    return np.bincount(doc, n, len(texts)).astype(np.int64) if len(doc) else np.zeros(len(texts), np.int64)


def token_counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, table_size: int = TABLE) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document."""
    small_batches(docs)
    sc = docs.sparkSession.sparkContext
    ranks = bpe.read_ranks(vocabulary)
    encode = bpe.encoder(ranks).encode_ordinary
    pieces = frequent(docs, table_size)
    shared = sc.broadcast((compact(pieces, [len(encode(p)) for p in pieces]), ranks))

    def run(batches):
        table, data = shared.value
        for b in batches:
            a = b.column("text")
            out = np.zeros(len(a), np.int64)
            for i, t in tk.blocks(strings(b, "text")):
                out[i : i + len(t)] = count(t.to_pylist(), table, data)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, mask=a.is_null().to_numpy(zero_copy_only=False))], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("n_tokens", "long"))
