"""Toxicity of texts restored by noisy-channel decoding.

Disguised strings (digits and signs for letters, letters set apart, letters repeated) are rows of a character
lattice: each place offers the character itself and the letters it may stand for, a repeated run may shrink, a
separator may vanish. The Viterbi path under a character trigram model, counted over all documents, restores
them. Words and word beginnings of the restored text are then looked up among those that labelled toxic texts use far
more often than labelled clean ones, and a logistic model of a text's evidence gives the score.

Which strings are decoded: while words are learned, those with plain signs of disguise. In scoring, every string whose
lattice has more than one path (a doubled letter, a sign for a letter anywhere, an inner separator) and every run of
three or more single characters, however far apart, if some path may spell a learned word: all paths of a string have
one skeleton (letters and their signs as classes, repeats as one, separators dropped), so a string whose skeletons
begin no learned word's is passed over by array operations without a change of the score.

Labels are read only where crc32(doc_id as text) mod 3 is not 1, at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` of them;
labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts are scored like any text without evidence; null doc_ids are scored and not
held out; repeated rows are kept each; without labels every score is 0; an empty table gives no rows; other
columns are ignored. Texts and strings of any length are read whole; strings beyond ``REMEMBERED`` characters aren't cached.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import ship, training_ids

TOXIC_ROWS, CLEAN_ROWS = 20_000, 40_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñàâçèêëîïôùûœæåøãõ"
A = len(ALPHABET) + 2  # 0: no letter, 1: another letter
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e"}
PREFIXES = (3, 4, 5, 6, 7, 8)
WHOLE = np.uint64(0xA5A5A5A5A5A5A5A5)
LEAST_WEIGHT = 2.5
#: Classes of a skeleton that are compared, and characters of a string whose decoding is remembered.
SKELETON, REMEMBERED = 8, 64
SUBSTITUTE, SHRINK, DROP = -1.0, -0.3, -0.2

_CODES = np.zeros(0x200, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i + 2
_CODES[[c for c in range(0x200) if chr(c).isalpha() and chr(c).lower() == chr(c) and not _CODES[c]]] = 1
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in STANDS_FOR if ord(c) < 128]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# letters and the signs that stand for them, as one class each
_CLASS = np.arange(256, dtype=np.uint8)
for _kin in ("il1!|", "bg869", "o0", "e3", "a4@", "s5$", "t7+"):
    for _c in _kin:
        _CLASS[ord(_c)] = ord(_kin[0])
_KEPT = _LETTER | _LEET | (np.arange(256) >= 0x30) & (np.arange(256) < 0x3A)
_EURO = (0xE2, 0x82, 0xAC)
_INNER = np.zeros(256, bool)
_INNER[[ord(c) for c in "._-*"]] = True


def skeletons(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first 1 to ``SKELETON`` classes from every place where a word may begin.

    Places, their strings (by the ranges given) and a row of hashes each; 0 where a string has no more classes.
    """
    n = len(data)
    kept = _KEPT[data].copy()
    classes = _CLASS[data]
    euro = np.flatnonzero((data[:-2] == _EURO[0]) & (data[1:-1] == _EURO[1]) & (data[2:] == _EURO[2])) if n > 2 else np.zeros(0, np.int64)
    classes[euro] = ord("e")
    kept[euro + 1] = kept[euro + 2] = False
    string = np.full(n + 1, -1, np.int64)
    string[starts] = np.arange(len(starts))
    string = np.maximum.accumulate(string)[:n]
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    at = np.flatnonzero(kept & (np.cumsum(inside)[:n] > 0))
    if not len(at):
        return at, at, np.zeros((0, SKELETON), np.uint64)
    own, cls = string[at], classes[at]
    begins = np.ones(len(at), bool)  # no letter stands right before, in the same string
    begins[1:] = (at[1:] - at[:-1] != 1) | (own[1:] != own[:-1])
    fresh = begins.copy()
    fresh[1:] |= cls[1:] != cls[:-1]
    at, own, cls, begins = at[fresh], own[fresh], cls[fresh], begins[fresh]
    first = np.flatnonzero(begins)
    h = vec.Hasher(cls)
    out = np.zeros((len(first), SKELETON), np.uint64)
    last = np.searchsorted(own, own[first], "right")
    for k in range(1, SKELETON + 1):
        fits = first + k <= last
        out[fits, k - 1] = h(first[fits], first[fits] + k)
    return at[first], own[first], out


def _code(c: str) -> int:
    return int(_CODES[ord(c)]) if ord(c) < 0x200 else int(c.isalpha())


class Channel:
    """A character trigram model and the decoder of disguised strings."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(A, A, A).astype(np.float64)
        one = c.sum(axis=(0, 1)) + 1.0
        two = c.sum(axis=0) + 5.0 * one / one.sum()
        two /= two.sum(axis=1, keepdims=True)
        three = c + 20.0 * two[None]
        self.log = np.log(three / three.sum(axis=2, keepdims=True)).astype(np.float32)
        self.restore = lru_cache(maxsize=1 << 16)(self._restore)

    def __reduce__(self):
        return _channel, (self.log,)

    def _restore(self, string: str) -> str:
        """The likeliest plain string behind one without inner white space, or of spaced single characters."""
        parts = string.split(" ")
        spaced = len(parts) > 1
        rows: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(string):
            c = string[i]
            j = i
            while j < len(string) and string[j] == c:
                j += 1
            run = j - i
            options = [(c * run, 0.0)]
            if c.isalpha() and run > 1:
                options += [(c * k, SHRINK) for k in (1, 2) if k < run]
            for letter in STANDS_FOR.get(c, ""):
                options += [(letter * k, SUBSTITUTE * k + (SHRINK if k < run else 0)) for k in sorted({1, 2, run}) if k <= run]
            if spaced and c in " ._-*,'" or c in "._-*" and 0 < i < len(string) - 1:
                options.append(("", DROP))
            rows.append(options)
            i = j
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in rows:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (p, q), (score, path) in states.items():
                for text, cost in options:
                    a, b, s = p, q, score + cost
                    for ch in text:
                        k = _code(ch)
                        s += float(log[a, b, k])
                        if not k and ch not in " ":
                            s -= 2.0  # digits and signs are rarer inside words than white space
                        a, b = b, k
                    old = after.get((a, b))
                    if old is None or s > old[0]:
                        after[a, b] = (s, (path, text))
            states = after
        best = max(((s + float(log[a, b, 0]), path) for (a, b), (s, path) in states.items()), key=lambda x: x[0])[1]
        out: list[str] = []
        while best:
            out.append(best[1])
            best = best[0]
        return "".join(reversed(out))

    def restored(self, data: np.ndarray, offsets: np.ndarray, learned: vec.Table | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased texts with disguised strings decoded; ``learned`` holds the skeletons of learned words."""
        data = vec.LOWER[data]
        spans = disguised(data, offsets)
        if learned is not None:
            spans = _apart(spans + ambiguous(data, offsets, learned))
        if not spans:
            return data, offsets
        raw, parts, pos, ends, grown = data.tobytes(), [], 0, [], []
        for a, b in spans:
            string = raw[a:b].decode("utf-8", "replace")
            new = (self.restore if len(string) <= REMEMBERED else self._restore)(string).encode()
            parts += [raw[pos:a], new]
            ends.append(b)
            grown.append(len(new) - (b - a))
            pos = b
        parts.append(raw[pos:])
        moved = np.concatenate([[0], np.cumsum(grown)])[np.searchsorted(ends, offsets, "right")]
        return np.frombuffer(b"".join(parts), np.uint8), offsets + moved


def _channel(log):
    c = Channel.__new__(Channel)
    c.log = log
    c.restore = lru_cache(maxsize=1 << 16)(c._restore)
    return c


def disguised(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges, in order and apart, that may hide a word; ``data`` is lower-cased."""
    n = len(data)
    if n < 3:
        return []
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    letter, leet = _LETTER[data], _LEET[data]
    # strings between white space
    s, e, _ = vec.words(data, offsets, vec.BLANK_WORDS)
    solid = ~cut[1:n]
    mixed = np.zeros(n, bool)  # a sign before a letter, after a letter or at a string's start
    mixed[:-1] = leet[:-1] & letter[1:] & solid
    begin = np.zeros(n, bool)
    begin[s] = True
    behind = np.concatenate([[False], (letter[:-1] | leet[:-1]) & solid])
    mixed &= begin | behind
    thrice = np.zeros(n, bool)
    thrice[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:] & (data[2:] < 0x80)
    marks = np.flatnonzero(mixed | thrice)
    spans = []
    if len(marks):
        t = np.unique(np.searchsorted(s, marks, "right") - 1)
        spans = list(zip(s[t].tolist(), e[t].tolist()))
    # single characters set apart by one sign or space
    ws, we, _ = vec.words(data, offsets, vec.ALNUM_WORDS)
    if len(ws) > 3:
        single = (we - ws == 1) | ((we - ws == 2) & (data[ws] >= 0xC0))
        near = np.zeros(len(ws), bool)
        near[:-1] = single[:-1] & single[1:] & (ws[1:] - we[:-1] == 1)
        at = np.flatnonzero(near)
        if len(at):
            between = ~cut[we[at]] & ~cut[ws[at + 1]]
            near[at[~between]] = False
        edge = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = b - a >= 3
        spans += list(zip(ws[a[keep]].tolist(), we[b[keep]].tolist()))
    return _apart(spans)


def ambiguous(data: np.ndarray, offsets: np.ndarray, learned: vec.Table) -> list[tuple[int, int]]:
    """Byte ranges of strings with more than one path of which one may spell a learned word, and of spaced letters."""
    n = len(data)
    if n < 2 or not learned.size:
        return []
    s, e, _ = vec.words(data, offsets, vec.BLANK_WORDS)
    if not len(s):
        return []
    letter = _LETTER[data]
    letters = np.concatenate([[0], np.cumsum(letter)])
    signs = np.concatenate([[0], np.cumsum(_LEET[data] | (data == _EURO[0]))])
    twice = np.zeros(n, bool)
    twice[1:] = (data[1:] == data[:-1]) & letter[1:]
    inner = _INNER[data].copy()
    inner[s] = False
    inner[e - 1] = False
    twice[s] = False
    other = np.concatenate([[0], np.cumsum(twice | inner)])
    many = (letters[e] > letters[s]) & (signs[e] > signs[s]) | (other[e] > other[s])
    spans = _spelling(data, s[many], e[many], learned)
    # runs of single characters, whatever stands between them
    ws, we, first = vec.words(data, offsets, vec.ALNUM_WORDS | _LEET)
    if len(ws) > 2:
        single = (we - ws == 1) | ((we - ws == 2) & (data[ws] >= 0xC0)) | ((we - ws == 3) & (data[ws] >= 0xE0))
        near = np.zeros(len(ws), bool)
        near[:-1] = single[:-1] & single[1:]
        near[first[1:-1][first[1:-1] > 0] - 1] = False  # the next word is another text's
        edge = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = b - a >= 2
        spans += _spelling(data, ws[a[keep]], we[b[keep]], learned)
    return spans


def _spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learned: vec.Table) -> list[tuple[int, int]]:
    """The ranges in which a learned word's skeleton begins."""
    if not len(starts):
        return []
    _, own, hashes = skeletons(data, starts, ends)
    hit = np.zeros(len(own), bool)
    for k in range(SKELETON):
        hit |= (hashes[:, k] != 0) & (learned.get(hashes[:, k]) >= 0)
    t = np.unique(own[hit])
    return list(zip(starts[t].tolist(), ends[t].tolist()))


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts; at most one row per trigram of the alphabet reaches the driver."""

    def run(iterator):
        total = np.zeros(A**3, np.int64)
        for (text,) in vec.batches(iterator, "text"):
            _, offsets = vec.text_bytes(text)
            for i, j in vec.chunks(offsets):
                whole = " ".join(t or "" for t in text.slice(i, j - i).to_pylist()).lower()
                cp = np.frombuffer(f"  {whole} ".encode("utf-32-le", "replace"), np.uint32)
                ids = _CODES[np.minimum(cp, 0x1FF)]
                k = (ids[:-2] * A + ids[1:-1]) * A + ids[2:]
                total += np.bincount(k, minlength=A**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["k", "n"])

    out = np.zeros(A**3, np.int64)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def features(data: np.ndarray, offsets: np.ndarray):
    """Per kind of feature (word beginnings, whole words) the hash for each word; and each word's text."""
    s, e, first = vec.words(data, offsets, vec.ALNUM_WORDS)
    h = vec.Hasher(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))

    def each():
        for k in PREFIXES:
            long = np.flatnonzero(e - s > k)
            yield long, h(s[long], s[long] + k)
        yield np.arange(len(s)), h(s, e) ^ WHOLE

    return each(), text


def _document_counts(docs: DataFrame, channel, known=None) -> DataFrame:
    """(f, n): in how many texts each feature occurs; ``known`` restricts them to a broadcast table."""

    def run(iterator):
        for (column,) in vec.batches(iterator, "text"):
            raw, offsets = vec.text_bytes(column)
            for i, j in vec.chunks(offsets, 1 << 21):
                data, off = channel.value.restored(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kinds, text = features(data, off)
                f, t = [], []
                for at, h in kinds:
                    if known is not None:
                        hit = known.value.get(h) >= 0
                        at, h = at[hit], h[hit]
                    f.append(h)
                    t.append(text[at])
                f, t = np.concatenate(f), np.concatenate(t)
                order = np.lexsort((t, f))
                f, t = f[order], t[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (t[1:] != t[:-1])
                f, n = np.unique(f[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n)], ["f", "n"])

    return docs.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _learned_skeletons(docs: DataFrame, channel, table) -> vec.Table:
    """The skeletons of the words and word beginnings in ``table``: one each, so no more than the table has."""

    def run(iterator):
        for (column,) in vec.batches(iterator, "text"):
            raw, offsets = vec.text_bytes(column)
            for i, j in vec.chunks(offsets, 1 << 21):
                data, off = channel.value.restored(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                s, e, _ = vec.words(data, off, vec.ALNUM_WORDS)
                kinds, _ = features(data, off)
                for size, (at, h) in zip((*PREFIXES, None), kinds):
                    at = at[table.value.get(h) >= 0]
                    _, one = np.unique(h[table.value.get(h) >= 0], return_index=True)
                    at = at[one]
                    parts = [data[s[x] : e[x] if size is None else s[x] + size] for x in at.tolist()]
                    ends = np.cumsum([len(x) for x in parts]).astype(np.int64)
                    if len(parts):
                        joined = np.concatenate(parts)
                        place, own, hashes = skeletons(joined, np.concatenate([[0], ends[:-1]]), ends)
                        lead = np.unique(own, return_index=True)[1]
                        whole = [int(row[row != 0][-1]) for row in hashes[lead]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(whole, np.uint64).view(np.int64))], ["h"])

    out = vec.Table()
    found = docs.select("text").mapInArrow(run, "h long").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    out.put(found, np.zeros(len(found), np.int32))
    return out


def _evidence(docs: DataFrame, channel, table, weights, learned, more: str = "") -> DataFrame:
    """Per row the largest weight of a word, how many words have one, and their share."""
    names = ["doc_id", "y"] if more else ["doc_id"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(iterator):
        for columns in vec.batches(iterator, *names, "text"):
            raw, offsets = vec.text_bytes(columns[-1])
            top, hits, share = (np.zeros(len(offsets) - 1) for _ in range(3))
            for i, j in vec.chunks(offsets):
                data, off = channel.value.restored(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], learned.value)
                kinds, text = features(data, off)
                best = np.zeros(len(text))
                for at, h in kinds:
                    v = table.value.get(h)
                    hit = np.flatnonzero(v >= 0)
                    np.maximum.at(best, at[hit], weights.value[v[hit]])
                hit = np.flatnonzero(best)
                np.maximum.at(top, i + text[hit], best[hit])
                hits[i:j] = np.bincount(text[hit], minlength=j - i)
                share[i:j] = hits[i:j] / np.maximum(np.bincount(text, minlength=j - i), 1)
            yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(top), pa.array(hits), pa.array(share)], [*names, "top", "hits", "share"])

    return docs.select(*names, "text").mapInArrow(run, f"doc_id {kind}, {more}top double, hits double, share double")


def _inputs(top, hits, share) -> np.ndarray:
    return np.stack([np.ones(len(top)), top / 4.0, np.log1p(hits), np.minimum(share * 50.0, 2.0)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 0.05, turns: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method; the two classes weigh alike."""
    if not y.any() or y.all():
        return np.array([-9.0 if not y.any() else 9.0, 0, 0, 0])
    w, b = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * 200 / len(y), np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[l2] * (x.shape[1] - 1)])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    channel = spark.sparkContext.broadcast(Channel(count_trigrams(rows)))  # A**3 numbers
    pick = {y: F.broadcast(training_ids(labels, "toxic", y, k)) for y, k in ((1, toxic_rows), (0, clean_rows))}
    of = {y: rows.join(ids, F.col("doc_id") == F.col("__id"), "left_semi") for y, ids in pick.items()}
    toxic = of[1].dropDuplicates(["text"])
    n = {1: toxic.count(), 0: of[0].count()}
    least = max(3, math.ceil(0.005 * n[1]))
    # a feature in 1 of 200 texts or more: their number is bounded by 200 times the features of a text
    often = _document_counts(toxic, channel).where(F.col("n") >= least).toPandas() if n[1] else None
    table, weights = vec.Table(), np.zeros(0)
    if often is not None and len(often):
        f, a = often["f"].to_numpy().view(np.uint64), often["n"].to_numpy().astype(float)
        known = vec.Table()
        known.put(f, np.arange(len(f), dtype=np.int32))
        clean = _document_counts(of[0], channel, spark.sparkContext.broadcast(known)).toPandas()
        c = np.zeros(len(f))
        c[known.get(clean["f"].to_numpy().view(np.uint64))] = clean["n"].to_numpy()
        w = np.log((a + 1) / (n[1] + 2)) - np.log((c + 1) / (n[0] + 2))
        keep = w >= LEAST_WEIGHT
        weights = w[keep]
        table.put(f[keep], np.arange(keep.sum(), dtype=np.int32))
    table, weights = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(weights)
    learned = spark.sparkContext.broadcast(_learned_skeletons(toxic, channel, table))
    labelled = toxic.withColumn("y", F.lit(1)).union(of[0].withColumn("y", F.lit(0)))
    seen = _evidence(labelled, channel, table, weights, learned, "y int, ").drop("doc_id").toPandas()  # bounded by the two limits
    model = _fit(_inputs(seen["top"].to_numpy(), seen["hits"].to_numpy(), seen["share"].to_numpy()), seen["y"].to_numpy())

    def run(iterator):
        for ids, top, hits, share in vec.batches(iterator, "doc_id", "top", "hits", "share"):
            z = _inputs(top.to_numpy(), hits.to_numpy(), share.to_numpy()) @ model
            yield pa.RecordBatch.from_arrays([ids, pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["doc_id", "score"])

    scored = _evidence(rows, channel, table, weights, learned).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
