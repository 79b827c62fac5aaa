"""Benchmark decontamination with a generalised suffix automaton over normalised words.

Test items are put into one automaton; training texts are streamed through it and the longest matching length
is tracked. Every length of ``window`` or more marks its last ``window`` words as hit, and a shorter item is hit
where it occurs whole. Only runs of words whose neighbouring pairs occur in some item reach the automaton;
the rest can't match and is passed over by array operations.

The automaton is broadcast in blocks of at most ``BLOCK_WORDS`` item words, one at a time: items are read through a
local iterator, what a block finds is stored before the next one is built, and results are merged per row. So neither
driver nor executors hold more than two blocks, however many items there are; texts are read once per block.

Defined results: null or empty texts have no words and no hits; null item texts are skipped; items of equal id
count once; repeated rows are kept each; empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import free_name, map_batches, materialize, ship

WINDOW = 13
BLOCK_WORDS = 400_000
SPANS = "spans string, items string"


def item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    data = vec.LOWER[data]
    s, e, _ = vec.words(data, np.array([0, len(data)]), vec.ALNUM_WORDS)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]


class Automaton:
    """A generalised suffix automaton of word sequences; ``items_at`` names the items that a state completes."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends, pairs = [], set()
        for _, words in items:
            last = 0
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for c in seq:
                last = self._extend(last, c)
            ends.append((seq, last))
            pairs.update(zip(seq, seq[1:]))
        self.shortest = min((min(window, len(s)) for s, _ in ends if s), default=window)
        self.items_at: dict[int, set[int]] = {}
        whole: dict[int, set[int]] = {}
        for k, (seq, last) in enumerate(ends):
            if 0 < len(seq) < window:
                whole.setdefault(last, set()).add(k)
            state, n = 0, 0
            for c in seq if len(seq) >= window else ():
                state, n = self.step(state, n, c)
                if n >= window:
                    self.items_at.setdefault(self.at_length(state, window), set()).add(k)
        #: The short items that are suffixes of a state's longest word sequence, by state.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in sorted(range(len(self.next)), key=self.length.__getitem__) if whole else ():
            own = [(k, self.length[v]) for k in whole.get(v, ())] + (self.short.get(self.link[v], []) if self.link[v] >= 0 else [])
            if own:
                self.short[v] = own
        names = list(self.vocabulary)
        hashes = np.array([vec.hash_word(w) for w in names], np.uint64)
        self.words = vec.Table()
        self.words.put(hashes, np.arange(len(names), dtype=np.int32))
        self.pairs = vec.Table()
        if pairs:
            a = np.array(sorted(pairs))
            self.pairs.put(vec.pair(hashes[a[:, 0]], hashes[a[:, 1]]), np.zeros(len(a), np.int32))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """The state and the longest matching length after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], n + 1
        return 0, 0

    def at_length(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def matches(self, words: list[int]):
        """(first, last word, items) of each occurrence of a window that ends at a word."""
        state = n = 0
        for i, c in enumerate(words):
            state, n = self.step(state, n, c)
            if n >= self.window:
                yield i - self.window + 1, i, self.items_at.get(self.at_length(state, self.window), ())
            for k, m in self.short.get(state, ()):
                if m <= n:
                    yield i - m + 1, i, (k,)

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: count of words, merged hit intervals of words, and the items hit; and the words' places."""
        data = vec.LOWER[data]
        starts, ends, first = vec.words(data, offsets, vec.ALNUM_WORDS)
        n = len(starts)
        counts = np.diff(first)
        found: dict[int, tuple[list, set]] = {}
        if n and self.words.size:
            h = vec.Hasher(data)(starts, ends)
            known = self.words.get(h)
            if self.shortest > 1:
                joined = np.zeros(n, bool)  # the word and the next one are a pair of some item, in one text
                joined[:-1] = (known[:-1] >= 0) & (known[1:] >= 0)
                ends_text = first[1:-1] - 1
                joined[ends_text[(ends_text >= 0) & (ends_text < n)]] = False
                some = np.flatnonzero(joined)
                joined[some] = self.pairs.get(vec.pair(h[some], h[some + 1])) >= 0
                need = self.shortest - 1
            else:
                joined, need = known >= 0, 1
                cut = np.zeros(n + 1, bool)
                cut[first] = True
            edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            keep = b - a >= need
            a, b = a[keep], b[keep] + (self.shortest > 1)
            if self.shortest == 1:  # runs may cross texts: cut them there
                spans = [(x, y) for s, e in zip(a.tolist(), b.tolist()) for x, y in _cut(s, e, cut)]
            else:
                spans = list(zip(a.tolist(), b.tolist()))
            doc = np.searchsorted(first, [s for s, _ in spans], "right") - 1
            for (s, e), d in zip(spans, doc.tolist()):
                base = s - int(first[d])
                for x, y, items in self.matches(known[s:e].tolist()):
                    runs, hit = found.setdefault(d, ([], set()))
                    if runs and x + base <= runs[-1][1] + 1 and x + base >= runs[-1][0]:
                        runs[-1][1] = max(runs[-1][1], y + base)
                    else:
                        runs.append([x + base, y + base])
                    hit.update(items)
        return counts, found, (starts, ends, first)


def _cut(s: int, e: int, cut: np.ndarray):
    inner = np.flatnonzero(cut[s + 1 : e]) + s + 1
    points = [s, *inner.tolist(), e]
    return list(zip(points, points[1:]))


def merged(runs: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Automata of the benchmark's items, each of at most ``block_words`` words (or one longer item)."""
    held, size = [], 0
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        words = item_words(r["t"])
        if held and size + len(words) > block_words:
            yield Automaton(held, window)
            held, size = [], 0
        if words:
            held.append((r["i"] if r["i"] is not None else "", words))
            size += len(words)
    yield Automaton(held, window)


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()


def detect(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.05, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    A text is contaminated if it has hits and they are ``coverage`` of its words or more.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship(spark)
    first, others = _one_or_more(blocks(benchmark, window, block_words))
    if others is not None:  # rows need a name of their own to be merged
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "decontam-rows")
    else:
        rows = rows.withColumn("__row", F.lit(0).cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, __row long, n_words long, {SPANS}"
    numerator = round(coverage * 1_000_000)

    def per_block(automaton, all_rows: bool):
        def run(iterator):
            for ids, row, text in vec.batches(iterator, "doc_id", "__row", "text"):
                data, offsets = vec.text_bytes(text)
                for i, j in vec.chunks(offsets):
                    part = offsets[i : j + 1] - offsets[i]
                    counts, found, _ = automaton.value.scan(data[offsets[i] : offsets[j]], part)
                    pick = range(j - i) if all_rows else sorted(found)
                    names = automaton.value.ids
                    spans = [json.dumps(merged(found[k][0])) if k in found else None for k in pick]
                    items = [json.dumps(sorted({names[x] for x in found[k][1]})) if k in found else None for k in pick]
                    take = pa.array([i + k for k in pick], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(take), row.take(take), pa.array(counts[list(pick)] if len(pick) else [], pa.int64()), pa.array(spans, pa.string()), pa.array(items, pa.string())], ["doc_id", "__row", "n_words", "spans", "items"])

        return run

    def finish(iterator):
        for ids, n_words, spans, items in vec.batches(iterator, "doc_id", "n_words", "spans", "items"):
            out = []
            for n, s, t in zip(n_words.to_pylist(), spans.to_pylist(), items.to_pylist()):
                runs = merged([x for y in s for x in json.loads(y)])
                hit = sum(b - a + 1 for a, b in runs)
                names = {x for y in t for x in json.loads(y)}
                out.append((hit, len(names), digest(names), hit > 0 and 1_000_000 * hit >= numerator * n))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.bool_()))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([ids, n_words, *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    out_schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if others is None:
        listed = rows.mapInArrow(per_block(spark.sparkContext.broadcast(first), True), schema).select("doc_id", "n_words", F.array_compact(F.array("spans")).alias("spans"), F.array_compact(F.array("items")).alias("items"))
        return listed.mapInArrow(finish, out_schema)
    parts = _block_by_block(spark, first, others, lambda a, k: rows.mapInArrow(per_block(a, k == 0), schema))
    grouped = parts.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return grouped.drop("__row").mapInArrow(finish, out_schema)


def _one_or_more(automata):
    """The first automaton, and an iterator over the others, or None if there is but one."""
    first, second = next(automata), next(automata, None)
    return first, None if second is None else chain([second], automata)


def _block_by_block(spark, first, others, found) -> DataFrame:
    """What each block finds, stored before the next one is built, so one block is held at a time."""
    every = None
    for k, automaton in enumerate(chain([first], others)):
        shared = spark.sparkContext.broadcast(automaton)
        part = materialize(found(shared, k), "decontam-block")
        shared.destroy()
        every = part if every is None else every.union(part)
    return every


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated passages, columns as they were.

    Hit words, with what stands between them, are cut out of a text; rows whose hits reach ``drop_coverage`` of
    their words are dropped. The spans of all blocks are merged first, so blocks don't change the result. ``n_chars``
    follows the text, where there is such a column. Rows without hits, null and empty texts are passed on unchanged;
    repeated rows are cut each; whole texts are read; columns are passed on whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    first, others = _one_or_more(blocks(benchmark, window, block_words))
    if others is None:
        return _cut_found(docs, spark.sparkContext.broadcast(first), drop_coverage)
    row, listed = free_name(docs, "row_key"), free_name(docs, "hit_spans")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    texts = rows.select(F.col(row).alias("__row"), F.col("text").cast("string").alias("text"))
    every = _block_by_block(spark, first, others, lambda a, k: _block_spans(texts, a))
    spans = every.groupBy(F.col("__row").alias(row)).agg(F.collect_list("spans").alias(listed))
    return _cut_listed(rows.join(spans, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], listed), drop_coverage)


def _block_spans(texts: DataFrame, automaton) -> DataFrame:
    """__row and the spans of one block's hits, for the rows that have any."""

    def run(iterator):
        for row, text in vec.batches(iterator, "__row", "text"):
            hits = _hits(text, automaton.value)
            at = sorted(hits)
            yield pa.RecordBatch.from_arrays([row.take(pa.array(at, pa.int64())), pa.array([json.dumps(hits[k]) for k in at], pa.string())], ["__row", "spans"])

    return texts.mapInArrow(run, "__row long, spans string")


def _hits(column, automaton: Automaton) -> dict[int, list[list[int]]]:
    """Merged hit spans by the row's place in ``column``."""
    out = {}
    data, offsets = vec.text_bytes(column)
    for i, j in vec.chunks(offsets):
        _, found, _ = automaton.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out.update({i + k: merged(runs) for k, (runs, _) in found.items()})
    return out


def _cut_found(docs: DataFrame, automaton, drop_coverage: float) -> DataFrame:
    def run(iterator):
        for batch in iterator:
            yield _cut_batch(batch, _hits(batch.column(batch.schema.get_field_index("text")), automaton.value), drop_coverage)

    return map_batches(docs, run)


def _cut_listed(rows: DataFrame, drop_coverage: float) -> DataFrame:
    """Cut the spans that ``__spans``, the last column, lists by block."""

    def run(iterator):
        for batch in iterator:
            listed = batch.column(batch.num_columns - 1).to_pylist()
            hits = {k: merged([x for y in s for x in json.loads(y)]) for k, s in enumerate(listed) if s}
            yield _cut_batch(batch.select(range(batch.num_columns - 1)), hits, drop_coverage)

    return map_batches(rows, run, drop=1)


def _cut_batch(batch: pa.RecordBatch, hits: dict[int, list[list[int]]], drop_coverage: float) -> pa.RecordBatch:
    if not hits:
        return batch
    at = batch.schema.get_field_index("text")
    data, offsets = vec.text_bytes(batch.column(at))
    texts, keep, lengths = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool), {}
    for k, runs in hits.items():
        own = data[offsets[k] : offsets[k + 1]]
        starts, ends, _ = vec.words(vec.LOWER[own], np.array([0, len(own)]), vec.ALNUM_WORDS)
        if sum(b - a + 1 for a, b in runs) >= drop_coverage * len(starts):
            keep[k] = False
            continue
        raw, pos, parts = own.tobytes(), 0, []
        for a, b in runs:
            parts.append(raw[pos : int(starts[a])])
            pos = int(ends[b])
        parts.append(raw[pos:])
        texts[k] = b"".join(parts).decode("utf-8", "replace")
        lengths[k] = len(texts[k])
    if lengths:
        field = batch.schema.field(at)
        batch = batch.set_column(at, field, pa.array(texts, field.type))
        c = batch.schema.get_field_index("n_chars")
        if c >= 0:
            n = batch.column(c).to_pylist()
            for k, v in lengths.items():
                n[k] = v
            batch = batch.set_column(c, batch.schema.field(c), pa.array(n, batch.schema.field(c).type))
    return batch if keep.all() else batch.filter(pa.array(keep))
