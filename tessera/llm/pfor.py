"""Token files in patched frame-of-reference blocks.

A file holds the ids of a run of documents. Ids are cut into blocks of 256; each block stores its minimum,
the offsets from it packed at a width chosen from percentiles of their bit lengths (the one that gives the
fewest bytes), and the offsets that don't fit in an exception list. An index of block starts in the header
allows any block to be read alone.

Layout, little endian: magic ``PFR1``; uint32 counts of documents, ids and blocks; per document an int64 id,
a uint8 that is 1 if the id is null, and a uint32 count of ids; per block a uint32 start in the payload, a
uint32 minimum, a uint8 width and a uint16 count of exceptions; the payload. A block's payload is its packed
words of 64 bits, then the exceptions' places (uint8), then their whole offsets (uint32).

Defined results: a null text is an empty one and still has its end id; a null doc_id is kept and sorts first;
repeated rows are kept each; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, vec
from .common import fresh_path, materialize, partitions_for, ship

BLOCK = 256
#: Blocks that are packed or unpacked at once.
TOGETHER = 1024
MAGIC = b"PFR1"
PERCENTILES = (50, 75, 90, 95, 99, 100)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of values below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of 256 values below 2**w as rows of 4 * w words of 64 bits."""
    k = len(v)
    lanes, out = v.reshape(k * 4, 64).astype(np.uint64), np.zeros((k * 4, w), np.uint64)
    for j in range(64 if w else 0):
        at, shift = j * w >> 6, j * w & 63
        out[:, at] |= lanes[:, j] << np.uint64(shift)
        if shift + w > 64:
            out[:, at + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.reshape(k, 4 * w)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    k = len(words)
    lanes, out, mask = words.reshape(k * 4, w), np.zeros((k * 4, 64), np.uint32), np.uint64((1 << w) - 1)
    for j in range(64 if w else 0):
        at, shift = j * w >> 6, j * w & 63
        x = lanes[:, at] >> np.uint64(shift)
        if shift + w > 64:
            x = x | lanes[:, at + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(k, BLOCK)


def _alike(width: np.ndarray):
    """Widths above 0 and the blocks of each, at most ``TOGETHER`` at once: places take 8 bytes for each packed one."""
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for i in range(0, len(rows), TOGETHER):
            yield w, rows[i : i + TOGETHER]


def dump(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - n)]).astype(np.uint32).reshape(blocks, BLOCK)
    low = padded.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = padded - low[:, None]
    bits = _bits(delta)
    ranked = np.sort(bits, axis=1)
    best, width = np.full(blocks, 1 << 30), np.zeros(blocks, np.uint8)
    for p in PERCENTILES:
        w = ranked[:, -(-p * BLOCK // 100) - 1] if blocks else width
        cost = 32 * w.astype(np.int64) + 5 * (bits > w[:, None]).sum(axis=1)
        width = np.where(cost < best, w, width)
        best = np.minimum(best, cost)
    out = bits > width[:, None]
    exceptions = out.sum(axis=1)
    size = 32 * width.astype(np.int64) + 5 * exceptions
    at = np.cumsum(size) - size
    payload = np.zeros(int(size.sum()), np.uint8)
    for w, rows in _alike(width):
        packed = _pack(np.where(out[rows], 0, delta[rows]), w).view(np.uint8)
        payload[at[rows][:, None] + np.arange(32 * w)] = packed
    b, place = np.nonzero(out)
    if len(b):
        first = np.cumsum(exceptions) - exceptions
        rank = np.arange(len(b)) - first[b]
        base = at[b] + 32 * width[b].astype(np.int64)
        payload[base + rank] = place
        high = delta[b, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        payload[(base + exceptions[b] + 4 * rank)[:, None] + np.arange(4)] = high
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [MAGIC, np.array([len(doc_ids), n, blocks], "<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.asarray(counts).astype("<u4").tobytes()]
        + [at.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), exceptions.astype("<u2").tobytes(), payload.tobytes()]
    )


class File:
    """A parsed header; ``ids(i, j)`` reads only the blocks that hold ids i to j."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a file of this format")
        docs, self.n, blocks = np.frombuffer(raw, "<u4", 3, 4).tolist()
        pos = 16

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal pos
            a = np.frombuffer(raw, kind, k, pos)
            pos += a.nbytes
            return a

        doc_ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist())]
        self.counts = take("<u4", docs).astype(np.int64)
        self.at, self.low, self.width, self.exceptions = take("<u4", blocks).astype(np.int64), take("<u4", blocks), take("u1", blocks), take("<u2", blocks).astype(np.int64)
        self.payload = np.frombuffer(raw, np.uint8, offset=pos)

    def ids(self, i: int = 0, j: int | None = None) -> np.ndarray:
        j = self.n if j is None else j
        a, b = i // BLOCK, -(-j // BLOCK)
        out, at, width = np.zeros((b - a, BLOCK), np.uint32), self.at[a:b], self.width[a:b]
        for w, rows in _alike(width):
            raw = self.payload[at[rows][:, None] + np.arange(32 * w)]
            out[rows] = _unpack(np.ascontiguousarray(raw).view("<u8"), w)
        k = self.exceptions[a:b]
        row = np.repeat(np.arange(b - a), k)
        if len(row):
            rank = np.arange(len(row)) - (np.cumsum(k) - k)[row]
            base = at[row] + 32 * width[row].astype(np.int64)
            high = self.payload[(base + k[row] + 4 * rank)[:, None] + np.arange(4)]
            out[row, self.payload[base + rank]] = np.ascontiguousarray(high).view("<u4")[:, 0]
        return (out + self.low[a:b, None]).reshape(-1)[i - a * BLOCK : j - a * BLOCK]


def store(path: str, raw: bytes) -> None:
    """Write whole or not at all: a repeated task replaces the file by the same bytes."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    part = f"{at}.{os.getpid()}.tmp"
    with files.open_output_stream(part) as f:
        f.write(raw)
    files.move(part, at)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_ids: int = 4 << 20) -> DataFrame:
    """Write ``docs`` in ascending doc_id order as files of about ``file_ids`` ids under ``folder``.

    Documents are range partitioned by doc_id, so ids of neighbours meet and no task holds more than its range.
    Returns one row per file in order: name, docs, n_tokens, base (ids in all files before).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = partitions_for(spark, max(n, (size or 0) // 2400), 7000)
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))

    def run(iterator):
        part, seq = TaskContext.get().partitionId(), 0
        docs_, counts, ids, total = [], [], [], 0

        def flush():
            nonlocal docs_, counts, ids, total, seq
            name = f"ids-{part:06d}-{seq:05d}.pfr"
            store(f"{folder}/{name}", dump(docs_, np.array(counts), np.concatenate(ids)))
            row = [part, seq, name, len(docs_), total]
            docs_, counts, ids, total, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "seq", "name", "docs", "n_tokens"])

        end = np.array([end_id], np.uint32)
        for d, text in vec.batches(iterator, "doc_id", "text"):
            d = d.to_pylist()
            for i, c, flat in bpe.encoded(text, tokenizer):
                pos = 0
                for k, m in enumerate(c.tolist()):
                    ids += [flat[pos : pos + m], end]
                    pos += m
                    docs_.append(d[i + k])
                    counts.append(m + 1)
                    total += m + 1
                    if total >= file_ids:
                        yield flush()
        if docs_:
            yield flush()

    # the text's hash deals null and repeated doc_ids over tasks
    keys = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    sorted_ = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text")
    manifest = materialize(sorted_.mapInArrow(run, "part long, seq long, name string, docs long, n_tokens long"), "pfor-files")
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("name", "docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("base"))


def read(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Decode all files: doc_id, start, n_tokens, ids_crc32 per document."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    joined = raw.join(manifest.select("name", "base"), "name")

    def run(iterator):
        for base, content in vec.batches(iterator, "base", "content"):
            for b, c in zip(base.to_pylist(), content):
                f = File(c.as_py())
                ids = memoryview(f.ids().astype("<u4").tobytes())
                stop = np.cumsum(f.counts)
                start = stop - f.counts
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(start.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(start + b), pa.array(f.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    ship(docs.sparkSession)
    folder = fresh_path(docs.sparkSession, "pfor")
    return read(docs.sparkSession, folder, write(docs, tokenizer, folder, end_id))
