"""Language ID: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased; every run of characters that aren't letters counts as one space.  Its
n-grams of 1 to ``ORDERS`` characters are hashed to ``BUCKETS`` columns.  The model is a matrix of log
probabilities, languages by columns, with additive smoothing and a uniform prior; it is
fitted on about ``TRAIN_ROWS`` labelled rows, of each language all or as many as of any other, and at least ``LEAST_ROWS`` or all,
chosen by a hash of the row, and broadcast (512 KiB a
language, whatever the corpus).  A batch is scored as a sparse count matrix times the log
probabilities: a gather and a segmented sum in numpy, over whole texts.  Nothing is shuffled but one
row per language and training task.

A document is rejected if it has no letter, if the best language's posterior is below
``MIN_POSTERIOR``, or if the best language explains it no better than a uniform distribution over
the columns does (it is in no language that the model knows).

Defined results: null and empty texts, and texts without letters, are rejected, with null language and
posterior 0; equal scores go to the language that sorts first; repeated rows each count; rows
without a label don't train; without any labelled row everything is rejected. Other columns are
handed on by :func:`keep_identified`, whatever their names.  Texts are scored whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import small_batches, strings

BUCKETS, ORDERS, ALPHA = 1 << 16, 3, 0.1
#: The bound on the labelled rows that train the model (the sample is near it, not exactly it).
TRAIN_ROWS = 20_000
#: A language has so many of its labelled rows, or all, even where the bound is then exceeded.
LEAST_ROWS = 500
MIN_POSTERIOR = 0.5
#: Bytes of text scored at once: each takes about 200 bytes of a worker's memory while it is.
BLOCK = 1 << 17

_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


_table: list[np.ndarray] = []


def columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(column of every n-gram, document of every n-gram) of some texts; no n-gram spans two texts."""
    if not _table:
        _table.append(_letters())
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    doc = np.repeat(np.arange(len(low) + 1), np.append(size + 1, 1))  # a text follows the line feed that begins it
    letter = _table[0][code]
    begin = np.zeros(len(code), np.bool_)
    begin[np.concatenate(([0], np.cumsum(size[:-1] + 1)))[: len(low)] if len(low) else []] = True
    keep = letter | begin
    keep[1:] |= letter[:-1]  # of a run without letters, its first character
    keep[-1:] = False
    code, doc = np.where(letter, code, np.uint32(32))[keep], doc[keep]
    out, owners = [], []
    h = np.zeros(len(code), np.uint32)
    for n in range(ORDERS):
        if len(code) <= n:
            break
        h = h[: len(code) - n] * np.uint32(0x01000193) + code[n:] * np.uint32(_MULT[n % 3])
        same = doc[n:] == doc[: len(doc) - n]
        x = h ^ (h >> np.uint32(15))
        x = x * np.uint32(0x2C1B3C6D)
        out.append(((x ^ (x >> np.uint32(16))) & np.uint32(BUCKETS - 1))[same])
        owners.append(doc[n:][same])
        h = h[: len(code) - n]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    col, own = np.concatenate(out).astype(np.int64), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return col[order], own[order]


def _share(sizes: list[int], rows: int) -> int:
    """The bound on the rows of one language by which all languages have about ``rows``; ``sizes`` ascend."""
    for i, v in enumerate(sizes):
        if v * (len(sizes) - i) >= rows:
            return max(LEAST_ROWS, rows // (len(sizes) - i))
        rows -= v
    return max(LEAST_ROWS, *sizes)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [column, language]) from the labels in ``lang``."""
    small_batches(docs)
    labelled = docs.select("lang", "text").where("lang is not null and text is not null")
    have = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    n = sum(have.values())
    if n > rows:
        most = _share(sorted(have.values()), rows)
        scarce = {k: int(most / v * (1 << 30)) for k, v in have.items() if v > most}
        if scarce:
            bound = F.create_map(*(F.lit(x) for kv in scarce.items() for x in kv))[F.col("lang")]
            labelled = labelled.where(bound.isNull() | (F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)) < bound))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for i, t in tk.blocks(b.column("text"), BLOCK):
                langs = b.column("lang").slice(i, len(t)).to_pylist()
                col, doc = columns(t.to_pylist())
                ends = np.searchsorted(doc, np.arange(len(t) + 1))
                for k, lang in enumerate(langs):
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total[lang] += np.bincount(col[ends[k] : ends[k + 1]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "counts"])

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros(BUCKETS, np.int64)
        for b in parts:
            for x in b.column("counts"):
                v += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([v.tobytes()], pa.binary())], ["lang", "counts"])

    kind = "lang string, counts binary"
    found = sorted((r.lang, np.frombuffer(r.counts, np.int64)) for r in labelled.mapInArrow(count, kind).groupBy("lang").applyInArrow(add, kind).toLocalIterator()) if n else []
    counts = np.array([c for _, c in found], np.float64).reshape(len(found), BUCKETS) + ALPHA
    return [k for k, _ in found], np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T)


def score(texts: list[str], model: tuple[list[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language's index, its posterior, accepted) of each text."""
    langs, logp = model
    k = len(texts)
    total = np.zeros((k, max(1, len(langs))))
    col, doc = columns(texts)
    size = np.bincount(doc, minlength=k)
    some = np.flatnonzero(size)
    if len(langs) and len(some):
        total[some] = np.add.reduceat(logp[col], np.searchsorted(doc, some), axis=0)
    best = total.argmax(1)
    top = total[np.arange(k), best]
    posterior = 1 / np.exp(total - top[:, None]).sum(1)
    solid = np.array([any(map(str.isalpha, t)) for t in texts], np.bool_)
    known = top > -np.log(BUCKETS) * size
    return best, posterior, solid & known & (posterior >= MIN_POSTERIOR) & bool(langs)


def _scored(batches, model, build):
    for b in batches:
        for i, t in tk.blocks(strings(b, "text"), BLOCK):
            yield build(b.slice(i, len(t)), *score(t.to_pylist(), model))


def identify(docs: DataFrame, labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, language, posterior, accepted)`` of every document; language is null where rejected."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs if labelled is None else labelled, rows))
    schema = docs.select("doc_id").schema.add("language", T.StringType()).add("posterior", T.DoubleType()).add("accepted", T.BooleanType())

    def build(b, best, posterior, ok):
        langs = model.value[0]
        names = [langs[k] if a else None for k, a in zip(best.tolist(), ok.tolist())]
        posterior = np.where([any(map(str.isalpha, x or "")) for x in b.column("text").to_pylist()], posterior, 0.0) if langs else np.zeros(len(ok))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(posterior), pa.array(ok)], ["doc_id", "language", "posterior", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: _scored(batches, model.value, build), schema)


def keep_identified(docs: DataFrame, labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't rejected."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs if labelled is None else labelled, rows))
    return docs.mapInArrow(lambda batches: _scored(batches, model.value, lambda b, best, posterior, ok: b.filter(pa.array(ok))), docs.schema)
