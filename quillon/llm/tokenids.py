"""Token IDs in training order, as fixed-stride binary shards.

Each document is encoded, ended with ``END`` and cut into sequences of ``LENGTH`` ids, the last padded with ``END``.
Sequences are numbered 0..N-1 by (doc_id, hash of the text), then place in the document.  A keyed
Feistel permutation of the next even power of two, walked along its cycle until it falls below N, maps each
number to its global slot: a bijection computed row by row, without a shuffle or a table.  Slots are cut into shards
of ``RECORDS`` records of equal size: slot s is at byte (s mod RECORDS) * stride of shard s div RECORDS.  A reader
resumes at any slot.

Texts are encoded once, into a table in the shared folder.  Numbering moves small rows only; the numbers of the rows that one task encoded
become one file, which whoever reads the rows again looks up.  Tokens are shuffled once, to their shards, packed and compressed by shard,
and in ``SLICES`` ranges of slots one after another, so that a fraction of them lies in shuffle files at a time.  A range has at most ``PARTITIONS`` tasks, however many its shards: each
writes neighbouring ones.

Defined results: null and empty texts are one sequence with no id but END; the length column counts a
sequence's ids with the END that closes the document, without padding; null doc_ids sort first; rows equal in id and text
are numbered side by side; texts are encoded whole, however long; other columns are ignored.  A vocabulary of more than 65,536 ids is refused:
a record holds 16-bit ids.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import remove, shared_folder, small_batches, strings, tidy, written

END, LENGTH, RECORDS, KEY, ROUNDS = 50256, 512, 16384, b"epoch-0", 6
#: Ranges of slots that are shuffled one after another, tasks in each at most, and bytes of records that a task packs at a time.
SLICES, PARTITIONS, HELD = 4, 4096, 32 << 20
_ROW = ["slot", "doc_id", "seq", "n_ids"]


def permute(x: np.ndarray, n: int, key: bytes = KEY) -> np.ndarray:
    """Slot in 0..n-1 of each number in 0..n-1: a keyed Feistel network with cycle walking."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(key + bytes([r])).digest()[:8], "little")) for r in range(ROUNDS)]

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    v = network(x.astype(np.uint64))
    out = np.flatnonzero(v >= n)
    while len(out):
        v[out] = network(v[out])
        out = out[v[out] >= n]
    return v.astype(np.int64)


def encoded(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """``(row, doc_id, tie, n_seq, ids)``: ids as compressed 16-bit numbers; written to the shared folder."""
    small_batches(docs)
    data = bpe.read_ranks(vocabulary)
    if bpe.encoder(data).n_vocab > 1 << 16:
        raise ValueError("records hold 16-bit ids; this vocabulary has more")
    ranks = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        encode = bpe.encoder(ranks.value).encode_ordinary
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                blobs, n, tie = [], [], []
                for t in strings(part, "text").to_pylist():
                    ids = np.array([*encode(t), END], "<u2")
                    blobs.append(pack(ids.tobytes()))
                    n.append(-(-len(ids) // length))
                    tie.append(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tie, pa.int64()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "tie", "n_seq", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tie long, n_seq long, ids binary")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "ids")


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``(row, before)``: how many sequences come before the row's; and how many there are."""
    order = ["doc_id", "tie", "row"]
    ranged = written(rows.select(*order, "n_seq").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "numbers")
    start, total = [], 0
    for r in ranged.groupBy("part").agg(F.sum("n_seq").alias("n")).orderBy("part").collect():  # one row per partition
        start.append((r.part, total))
        total += r.n
    offsets = rows.sparkSession.createDataFrame(start, "part int, start long")
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = ranged.withColumn("upto", F.sum("n_seq").over(here)).join(F.broadcast(offsets), "part")
    return done.select("row", (F.col("start") + F.col("upto") - F.col("n_seq")).alias("before")), total


def _save(fs, folder: str, name: str, data) -> None:
    """A whole file or none: written under a name of this attempt, then renamed."""
    own = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, f"{folder}/{name}")


def number_files(numbers: DataFrame, folder: str) -> None:
    """One file of 64-bit numbers for the rows of each task that encoded some, in their order."""

    def save(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        held: list[np.ndarray] = []
        at = None
        for b in batches:
            part, before = b.column("row").to_numpy() >> 33, b.column("before").to_numpy()
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
            for a, z in zip(cut, [*cut[1:], len(part)]):
                if at is not None and part[a] != at:
                    _save(fs, root, f"{at}.bin", np.concatenate(held).tobytes())
                    held = []
                at = part[a]
                held.append(before[a:z].astype("<i8"))
        if at is not None:
            _save(fs, root, f"{at}.bin", np.concatenate(held).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])

    task = F.shiftright("row", 33)
    last = numbers.agg(F.max(task)).first()[0] or 0
    with tidy(numbers.sparkSession):
        numbers.repartitionById(min(PARTITIONS, last + 1), F.pmod(task, F.lit(min(PARTITIONS, last + 1))).cast("int")).sortWithinPartitions("row").mapInArrow(save, "n long").agg(F.sum("n")).collect()


def write_shards(docs: DataFrame, folder: str, vocabulary: str = bpe.VOCABULARY, length: int = LENGTH, records: int = RECORDS, key: bytes = KEY) -> dict:
    """Write ``shard-<i>.bin`` of ``docs``, and ``manifest.json``, to ``folder``; returns the manifest.

    ``folder`` is a URI that pyarrow can open (file, hdfs, s3).  The records' doc_id, place in the document, ids without padding, and slot go
    to ``rows-<i>.arrow``, in the same order.  A repeated task leaves whole files; the manifest comes last.
    """
    spark = docs.sparkSession
    rows = encoded(docs, vocabulary, length)
    numbers, total = numbered(rows)
    where = f"{shared_folder(spark)}/numbers-{uuid.uuid4().hex}"
    number_files(numbers, where)
    kind = rows.select("doc_id").schema
    n_shards = -(-total // records)

    def cut(first, last):
        def run(batches):
            unpack = zstandard.ZstdDecompressor().decompress
            fs, root = pa.fs.FileSystem.from_uri(where)
            part, before = -1, None
            held: list[tuple] = []
            for b in batches:
                row = b.column("row").to_numpy()
                start = np.empty(b.num_rows, np.int64)
                for p in np.unique(row >> 33).tolist():
                    if p != part:
                        part = p
                        with fs.open_input_file(f"{root}/{part}.bin") as f:
                            before = np.frombuffer(f.read(), "<i8")
                    own = row >> 33 == p
                    start[own] = before[row[own] & ((1 << 33) - 1)]
                count = b.column("n_seq").to_numpy()
                owner = np.repeat(np.arange(b.num_rows), count)
                seq = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                slot = permute(start[owner] + seq, total, key)
                inside = np.flatnonzero((slot >= first) & (slot < last))
                owner, seq, slot = owner[inside], seq[inside], slot[inside]
                # only texts with a record here are unpacked, each at its own place of one array
                some = np.unique(owner)
                at = np.zeros(b.num_rows, np.int64)
                at[some] = np.cumsum(count[some]) - count[some]
                full = np.full((int(count[some].sum()), length), END, "<u2")
                flat, size, blobs = full.reshape(-1), np.zeros(b.num_rows, np.int64), b.column("ids")
                for r, k in zip(some.tolist(), (at[some] * length).tolist()):
                    x = np.frombuffer(unpack(blobs[r].as_buffer()), "<u2")
                    flat[k : k + len(x)] = x
                    size[r] = len(x)
                held.append((slot, b.column("doc_id").take(pa.array(owner)), seq.astype(np.int32), np.minimum(length, size[owner] - length * seq).astype(np.int32), full[at[owner] + seq]))
                if sum(len(h[0]) for h in held) * 2 * length > HELD:
                    yield from packed(held)
                    held = []
            if held:
                yield from packed(held)

        def packed(held):
            pack = zstandard.ZstdCompressor(level=3).compress
            slot, seq, size, ids = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 4))
            owner = pa.concat_arrays([h[1] for h in held])
            shard = slot // records
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) > 0)).tolist() if len(order) else []
            for a, z in zip(cuts, [*cuts[1:], len(order)]):
                o = order[a:z]
                sink = pa.BufferOutputStream()
                made = pa.RecordBatch.from_arrays([pa.array(slot[o]), owner.take(pa.array(o)), pa.array(seq[o]), pa.array(size[o])], _ROW)
                with pa.ipc.new_stream(sink, made.schema) as w:
                    w.write_batch(made)
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[o[0]])], pa.int32()), pa.array([pack(sink.getvalue())], pa.binary()), pa.array([pack(ids[o].tobytes())], pa.binary())], ["shard", "rows", "ids"])

        return run

    def save(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        at, n = None, 0

        def one():
            made = pa.concat_tables([pa.ipc.open_stream(unpack(x)).read_all() for x, _ in held]).combine_chunks()
            ids = np.frombuffer(b"".join(unpack(x) for _, x in held), "<u2").reshape(-1, length)
            order = np.argsort(made.column("slot").to_numpy())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(made.take(pa.array(order)))
            _save(fs, root, f"rows-{at:06d}.arrow", sink.getvalue())
            _save(fs, root, f"shard-{at:06d}.bin", ids[order].tobytes())
            return len(order)

        for b in batches:
            for s, rows_, ids in zip(b.column("shard").to_pylist(), b.column("rows"), b.column("ids")):
                if s != at:
                    n += one() if held else 0
                    held = []
                at = s
                held.append((rows_.as_py(), ids.as_py()))
        n += one() if held else 0
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    width = max(1, -(-n_shards // SLICES))  # shards in a range of slots
    done = 0
    for first in range(0, n_shards, width):
        last = min(n_shards, first + width)
        each = -(-(last - first) // PARTITIONS)  # neighbouring shards to a task
        parts = -(-(last - first) // each)
        blobs = rows.select("row", "doc_id", "n_seq", "ids").mapInArrow(cut(first * records, last * records), "shard int, rows binary, ids binary")
        routed = blobs.repartitionById(parts, ((F.col("shard") - first) / each).cast("int")).sortWithinPartitions("shard")
        with tidy(spark):
            done += routed.mapInArrow(save, "n long").agg(F.sum("n")).first()[0] or 0
    if done != total:
        raise RuntimeError(f"{done} of {total} sequences were written")
    manifest = {"length": length, "stride": 2 * length, "records_per_shard": records, "sequences": total, "shards": n_shards, "doc_id": kind["doc_id"].dataType.simpleString()}
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    _save(fs, root, "manifest.json", json.dumps(manifest).encode())
    remove(rows)
    return manifest


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(slot, shard, doc_id, seq, n_ids, record)`` from the files of :func:`write_shards`, in order of slots; record is the bytes on disk."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    stride = m["stride"]

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for shard in (x for b in batches for x in b.column("id").to_pylist()):
            with fs.open_input_stream(f"{root}/shard-{shard:06d}.bin") as f, fs.open_input_stream(f"{root}/rows-{shard:06d}.arrow") as g:
                for b in pa.ipc.open_stream(g):
                    for i in range(0, b.num_rows, 256):
                        part = b.slice(i, 256)
                        data = f.read(part.num_rows * stride)
                        record = pa.array([data[k : k + stride] for k in range(0, len(data), stride)], pa.binary())
                        yield pa.RecordBatch.from_arrays([part.column("slot"), pa.array([shard] * part.num_rows, pa.int32()), *(part.column(c) for c in _ROW[1:]), record], ["slot", "shard", *_ROW[1:], "record"])

    shards = spark.range(0, m["shards"], 1, max(1, min(PARTITIONS, m["shards"])))
    return shards.mapInArrow(run, f"slot long, shard int, doc_id {m['doc_id']}, seq int, n_ids int, record binary")


def shards(docs: DataFrame, folder: str, vocabulary: str = bpe.VOCABULARY, length: int = LENGTH, records: int = RECORDS, key: bytes = KEY) -> DataFrame:
    """Write the shards and the manifest of ``docs`` to ``folder``; its rows, read back from there."""
    write_shards(docs, folder, vocabulary, length, records, key)
    return read_rows(docs.sparkSession, folder)


def read_slots(folder: str, first: int = 0, count: int | None = None):
    """The id arrays of ``count`` slots from ``first`` on, read in order by offset."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    last = m["sequences"] if count is None else min(m["sequences"], first + count)
    per, stride = m["records_per_shard"], m["stride"]
    while first < last:
        shard, at = divmod(first, per)
        n = min(last - first, per - at)
        with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(at * stride)
            data = np.frombuffer(f.read(n * stride), "<u2").reshape(n, m["length"])
        yield from data
        first += n
