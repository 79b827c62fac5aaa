"""Best-fit packing with certified bin counts.

Pieces of documents are packed in partitions by best-fit decreasing. Dual-feasible functions give a lower bound
of each partition's bin count: a partition that meets it is certified and done. The others keep their full bins
and exchange the documents of the rest, which are dealt anew to fewer partitions and packed again, until the
bound is met, or the exchange no longer helps. The histogram of all piece lengths gives the global bound.

Defined results: a null text is empty and still has its end id; null or repeated doc_ids are kept, each row is
packed on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, vec
from .common import materialize, partitions_for, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, open boolean, gap long"


def cut(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Token pieces of every document; of one that is too long the first piece takes what the others leave."""

    def run(iterator):
        end = np.array([end_id], "<u4").tobytes()
        for ids, text in vec.batches(iterator, "doc_id", "text"):
            ids = ids.to_pylist()
            for i, counts, flat in bpe.encoded(text, tokenizer):
                raw, pos, rows = flat.astype("<u4").tobytes(), 0, []
                for k, m in enumerate(counts.tolist()):
                    own = raw[4 * pos : 4 * (pos + m)] + end
                    pos += m
                    n, a, p = m + 1, 0, 0
                    b = (n - 1) % size + 1
                    while a < n:
                        rows.append((ids[i + k], p, a, b - a, zlib.crc32(own[4 * a : 4 * b])))
                        a, b, p = b, b + size, p + 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs; counts[x] pieces have length x, the last index is a bin's size.

    The largest bound over two families of dual-feasible functions: for each threshold a, lengths over size - a
    count 1, those below a count 0 and the others their share; and for k up to 20 the rounded multiples
    floor((k + 1) x / size) / k, where whole multiples keep x / size.
    """
    size = len(counts) - 1
    x = np.arange(size + 1)
    mass, many = np.cumsum(counts * x), np.cumsum(counts)
    best = -(-int(mass[-1]) // size) if size else 0
    a = np.arange(1, size // 2 + 1)
    middle = mass[size - a] - mass[a - 1]
    best = max(best, int(np.max(many[-1] - many[size - a] + -(-middle // size), initial=0)))
    for k in range(1, 21):
        whole = (k + 1) * x % size == 0
        parts = np.where(whole, k * x, (k + 1) * x // size * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((counts * parts).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each piece, and each bin's free room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit r: a bin has room r
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        up = mask >> need
        if up:
            room = need + (up & -up).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = size, len(free)
            free.append(size)
        bins[i], offsets[i], room = b, size - room, room - need
        free[b] = room
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(free, np.int64)


def _pack_partition(rows: pa.Table, size: int, turn: int, part: int, spare: float) -> pa.Table:
    lengths = rows.column("length").to_numpy()
    bins, offsets, free = best_fit(lengths, size)
    gap = len(free) - lower_bound(np.bincount(lengths, minlength=size + 1))
    open_ = np.zeros(len(free), bool)
    if gap > 0:  # what the gap can free, with partners to fill
        k = min(len(free), max(int(spare * len(free)), 16 * gap, 64))
        roomy = np.argsort(-free, kind="stable")[:k]
        open_[roomy[free[roomy] > 0]] = True
    seq = (turn << 56) + (part << 32) + bins
    more = [pa.array(seq), pa.array(offsets), pa.array(open_[bins]), pa.array(np.full(len(bins), gap))]
    for name, column in zip(("sequence_id", "offset", "open", "gap"), more):
        rows = rows.append_column(name, column)
    return rows


def pack(pieces: DataFrame, size: int = 1024, per: int = 60_000, turns: int = 12, spare: float = 0.1) -> DataFrame:
    """Place pieces (already stored) in sequences; adds sequence_id and offset.

    ``per`` bounds the pieces of a partition, so a task's memory doesn't grow with the input. Full pieces fill a
    sequence each and never take part in an exchange.
    """
    spark, names = pieces.sparkSession, [x.split()[0] for x in PIECES.split(", ")]
    schema = PACKED
    full = F.col("length") == size
    n = pieces.where(~full).count()
    parts, todo, done = partitions_for(spark, n, per), pieces.where(~full), []

    def alone(iterator):
        part, k = TaskContext.get().partitionId(), 0
        for batch in iterator:
            seq = (127 << 56) + (part << 32) + k + np.arange(batch.num_rows)
            k += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(np.zeros(batch.num_rows, np.int64))], [*batch.schema.names, "sequence_id", "offset"])

    singles = pieces.where(full).select(*names).mapInArrow(alone, PIECES + ", sequence_id long, offset long")
    for turn in range(turns):

        def run(iterator, turn=turn):
            held = list(iterator)
            if held and sum(b.num_rows for b in held):
                yield from _pack_partition(pa.Table.from_batches(held).combine_chunks(), size, turn, TaskContext.get().partitionId(), spare).to_batches()

        dealt = todo.select(*names)
        dealt = dealt.coalesce(1) if parts == 1 else dealt.repartition(parts, F.xxhash64("doc_id", "piece", F.lit(turn)))
        packed = materialize(dealt.mapInArrow(run, schema), f"pack-{turn}")
        left = packed.where("open").count() if parts > 1 and turn + 1 < turns else 0
        if not left:
            done.append(packed)
            break
        done.append(packed.where("not open"))
        todo, parts = packed.where("open"), min(parts - 1, partitions_for(spark, left, per))
    out = singles
    for d in done:
        out = out.union(d.select(*names, "sequence_id", "offset"))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    ship(docs.sparkSession)
    return pack(materialize(cut(docs, tokenizer, size, end_id), "pieces"), size)


def report(packed: DataFrame, size: int = 1024) -> dict:
    """Sequences used, and the bound that no packing of these pieces can beat."""
    rows = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `size` rows
    counts = np.zeros(size + 1, np.int64)
    for r in rows:
        counts[r["length"]] = r["n"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": lower_bound(counts)}
