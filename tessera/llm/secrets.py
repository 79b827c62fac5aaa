"""Secret scanning with inferred grammars.

Three base rules find assigned credentials, access keys and long hexadecimal strings. Values that they find are
labelled credentials: from a bounded sample of each kind a prefix tree is built, and its statistically compatible
states are merged (ALERGIA, a Hoeffding test at each pair) into a probabilistic automaton. Every other run of eight
or more credential characters, plain words too, is then scored: by the best automaton's likelihood against that of
a background model, letter pairs counted over such runs of all documents but the labelled ones. Those that gain ``GAIN`` bits a character
and ``EVIDENCE`` bits in all are spans of the kind ``grammar``. Without labelled credentials there is no automaton.

Values never reach a disk in the clear: what is stored of them is enciphered with a key that lives in memory only.

Defined results: a null text is empty and has no spans; null and repeated doc_ids are kept each, so are repeated
rows; very long texts and runs are read whole; of equal spans the base rule's stays; empty tables give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import discard, map_batches, materialize, ship

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Characters of a candidate at least.
SHORTEST = 8
#: Labelled values per kind that an automaton is built from, at most.
SAMPLE = 400
#: Bits a character, and in all, by which an automaton must beat the background.
GAIN, EVIDENCE = 0.35, 20.0
ALPHA = 0.05

_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(SYMBOLS, np.uint8)] = np.arange(len(SYMBOLS))
_RUN = _CODE < 255
_CORE = np.zeros(256, bool)
_CORE[np.frombuffer(SYMBOLS[:62], np.uint8)] = True
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
N = len(SYMBOLS)
EDGE = N  # the symbol before the first and after the last character


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of the base rules, by start and kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _may_have_base(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the texts that hold a word of the base rules, or enough hexadecimal digits on end."""
    starts, ends, _ = vec.words(data, offsets, _HEX)
    at = [starts[ends - starts >= 32]]
    for raw, marks in ((vec.LOWER[data].tobytes(), HINTS), (data.tobytes(), (b"AKIA",))):
        for mark in marks:
            found, i = [], raw.find(mark)
            while i >= 0:
                found.append(i)
                i = raw.find(mark, i + 1)
            at.append(np.array(found, np.int64))
    return np.unique(np.searchsorted(offsets, np.concatenate(at), "right") - 1)


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates: runs of credential characters from the first letter or digit to the last,
    and up to two signs of padding after it."""
    starts, ends, _ = vec.words(data, offsets, _RUN)
    keep = ends - starts >= SHORTEST
    starts, ends = starts[keep], ends[keep]
    core = np.flatnonzero(_CORE[data]) if len(data) else np.zeros(0, np.int64)
    a, b = np.searchsorted(core, starts), np.searchsorted(core, ends)
    keep = b > a
    starts, stops, ends = core[a[keep]], core[b[keep] - 1] + 1, ends[keep]
    for _ in range(2):
        more = stops < ends
        more[more] = data[stops[more]] == 61
        stops = stops + more
    keep = stops - starts >= SHORTEST
    return starts[keep], stops[keep]


def pair_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each pair of symbols stands in the candidates, edges included."""
    codes = _CODE[data].astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    within = np.cumsum(inside)[: len(data)] > 0
    second = within.copy()
    second[starts] = False
    at = np.flatnonzero(second)
    counts = np.bincount(codes[at - 1] * (N + 1) + codes[at], minlength=(N + 1) ** 2)
    counts += np.bincount(EDGE * (N + 1) + codes[starts], minlength=(N + 1) ** 2)
    counts += np.bincount(codes[ends - 1] * (N + 1) + EDGE, minlength=(N + 1) ** 2)
    return counts


class Background:
    """The likelihood of runs by their pairs of symbols."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(N + 1, N + 1) + 0.1
        self.bits_of = np.log2(c / c.sum(axis=1, keepdims=True))

    def bits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes = np.minimum(_CODE[data], EDGE).astype(np.int64)
        step = np.zeros(len(data) + 1)
        np.cumsum(self.bits_of[codes[:-1], codes[1:]], out=step[1:-1]) if len(data) > 1 else None
        return self.bits_of[EDGE, codes[starts]] + (step[ends - 1] - step[starts]) + self.bits_of[codes[ends - 1], EDGE]


class Grammar:
    """A deterministic probabilistic automaton inferred from strings."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.n: list[int] = [0]
        self.end: list[int] = [0]
        self.count: list[dict[str, int]] = [{}]
        for v in values:
            q = 0
            self.n[0] += 1
            for c in v:
                self.count[q][c] = self.count[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.n)
                    self.next.append({})
                    self.n.append(0)
                    self.end.append(0)
                    self.count.append({})
                q = self.next[q][c]
                self.n[q] += 1
            self.end[q] += 1
        self._merge_all()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a == b:
                continue
            if self._differ(self.end[a], self.n[a], self.end[b], self.n[b]):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), self.n[a], self.count[b].get(c, 0), self.n[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for c, k in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + k
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_all(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        done = {0}
        while blue:
            p, c = blue.pop(0)
            b = self.next[p][c]
            if b in done:
                continue
            for r in red:
                if self._compatible(r, b):
                    self.next[p][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
                done.add(b)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in done]
        self.done = done

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state and log2 likelihood by state and symbol, with a small chance for unseen ones, and of the end."""
        number = {q: i for i, q in enumerate(sorted(self.done))}
        nxt = np.repeat(np.arange(len(number))[:, None], N, axis=1).astype(np.int64)
        bits = np.zeros((len(number), N))
        end = np.zeros(len(number))
        for q, i in number.items():
            n = self.n[q]
            bits[i] = math.log2(0.01 / (n + 0.01 * N))
            for c, k in self.count[q].items():
                bits[i, _CODE[ord(c)]] = math.log2((k + 0.01) / (n + 0.01 * N))
            for c, t in self.next[q].items():
                nxt[i, _CODE[ord(c)]] = number[t]
            end[i] = math.log2((self.end[q] + 0.5) / (n + 1))
        return nxt, bits, end


class Model:
    """Automata and background: what is needed to score any run."""

    def __init__(self, grammars: list[Grammar], counts: np.ndarray):
        self.tables, self.background = [g.tables() for g in grammars], Background(counts)

    def grammar_bits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log2 likelihood of each run under its best automaton, all runs a character at a time."""
        best = np.full(len(starts), -np.inf)
        order = np.argsort(starts - ends, kind="stable")
        first, size = starts[order], (ends - starts)[order]
        codes = _CODE[data].astype(np.int64)
        for nxt, bits, end in self.tables:
            q, total = np.zeros(len(first), np.int64), np.zeros(len(first))
            j, n = 0, len(first)
            while n > 8 or n and size[0] - j <= 64:
                n = int(np.searchsorted(-size, -j, "left"))  # runs longer than j come first
                if not n:
                    break
                c = codes[first[:n] + j]
                total[:n] += bits[q[:n], c]
                q[:n] = nxt[q[:n], c]
                j += 1
            for i in range(n):  # few long ones are left
                state, sum_ = int(q[i]), 0.0
                for c in codes[first[i] + j : first[i] + size[i]].tolist():
                    sum_ += bits[state, c]
                    state = nxt[state, c]
                q[i], total[i] = state, total[i] + sum_
            best[order] = np.maximum(best[order], total + end[q])
        return best

    def gains(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits by which the best automaton beats the background."""
        if not self.tables or not len(starts):
            return np.full(len(starts), -np.inf)
        return self.grammar_bits(data, starts, ends) - self.background.bits(data, starts, ends)

    def found(self, data: np.ndarray, offsets: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = candidates(data, offsets)
        gain = self.gains(data, starts, ends)
        keep = (gain > limit * (ends - starts)) & (gain > EVIDENCE)
        return starts[keep], ends[keep]


def spans_of(column, model: Model | None, limit: float = GAIN):
    """(place, text, base spans, added spans) of each text of a column that has any; spans are of code points."""
    whole, at = vec.text_bytes(column)
    for i, j in vec.chunks(at):
        data, offsets = whole[at[i] : at[j]], at[i : j + 1] - at[i]
        base = set(_may_have_base(data, offsets).tolist())
        more = defaultdict(list)
        if model is not None:
            starts, ends = model.found(data, offsets, limit)
            for t, a, b in zip((np.searchsorted(offsets, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
                more[t].append((a, b))
        for t in sorted(base | set(more)):
            lo = int(offsets[t])
            raw = data[lo : offsets[t + 1]]
            text = raw.tobytes().decode("utf-8", "replace")
            own = base_spans(text) if t in base else []
            point = np.cumsum((raw & 0xC0) != 0x80) if len(text) < len(raw) else None
            added, k, reach = [], 0, -1
            for a, b in more[t]:
                a, b = a - lo, b - lo
                if point is not None:
                    a, b = int(point[a]) - 1, int(point[b - 1])
                while k < len(own) and own[k][0] < b:
                    reach = max(reach, own[k][2])
                    k += 1
                if reach <= a:
                    added.append((a, b))
            if own or added:
                yield i + t, text, own, added


def _sealed(value: str, key: bytes) -> bytes:
    nonce, raw = os.urandom(12), value.encode()
    return nonce + bytes(x ^ y for x, y in zip(raw, hashlib.shake_256(key + nonce).digest(len(raw))))


def _opened(sealed: bytes, key: bytes) -> str:
    nonce, raw = sealed[:12], sealed[12:]
    return bytes(x ^ y for x, y in zip(raw, hashlib.shake_256(key + nonce).digest(len(raw)))).decode()


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Automata of the labelled values, those with the smallest keyed hashes, and the background of all documents."""
    ship(docs.sparkSession)
    key = os.urandom(32)
    value_t = pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64()), ("x", pa.binary())]))
    pair_t = pa.list_(pa.struct([("p", pa.int32()), ("n", pa.int64())]))

    def run(iterator):
        counts = np.zeros((N + 1) ** 2, np.int64)
        for (column,) in vec.batches(iterator, "text"):
            whole, at = vec.text_bytes(column)
            values = []
            for i, j in vec.chunks(at):
                data, offsets = whole[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends = candidates(data, offsets)
                free = np.ones(len(starts), bool)  # labelled credentials are no background
                for t, text, own, _ in spans_of(column.slice(i, j - i), None):
                    a, b = np.searchsorted(starts, offsets[t : t + 2])
                    for first, _, last, _ in own:
                        x, y = (offsets[t] + len(text[:c].encode("utf-8", "replace")) for c in (first, last))
                        free[a:b] &= (starts[a:b] >= y) | (ends[a:b] <= x)
                    values.append((i + t, own))
                if len(data):
                    counts += pair_counts(data, starts[free], ends[free])
            values = [[{"k": k, "h": int.from_bytes(hashlib.blake2b(v.encode(), key=key, digest_size=8).digest(), "little", signed=True), "x": _sealed(v, key)} for _, k, _, v in own] for _, own in values]
            yield pa.RecordBatch.from_arrays([pa.array(values, value_t), pa.nulls(len(values), pair_t)], ["found", "pairs"])
        at = np.flatnonzero(counts)
        pairs = [{"p": int(p), "n": int(n)} for p, n in zip(at, counts[at])]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, value_t), pa.array([pairs], pair_t)], ["found", "pairs"])

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "found array<struct<k:int,h:long,x:binary>>, pairs array<struct<p:int,n:long>>")
    seen = materialize(seen, "secrets")
    counts = np.zeros((N + 1) ** 2)
    for r in seen.select(F.inline("pairs")).groupBy("p").agg(F.sum("n").alias("n")).collect():  # at most one row per pair of symbols
        counts[r["p"]] = r["n"]
    values = seen.select(F.inline("found")).groupBy("k", "h").agg(F.first("x").alias("x"))
    grammars = []
    for k in range(len(KINDS)):
        own = [_opened(bytes(r["x"]), key) for r in values.where(F.col("k") == k).orderBy("h").limit(sample).collect()]
        if own:
            grammars.append(Grammar(own))
    discard(seen)
    return Model(grammars, counts)


def find_secrets(docs: DataFrame, sample: int = SAMPLE, limit: float = GAIN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, by start) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))  # built from bounded samples
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = hashlib.sha256(b"").hexdigest()

    def run(iterator):
        for ids, text in vec.batches(iterator, "doc_id", "text"):
            n = np.zeros((len(KINDS), len(ids)), np.int64)
            digests, listed = [none] * len(ids), [""] * len(ids)
            for i, _, own, added in spans_of(text, model.value, limit):
                for _, k, _, _ in own:
                    n[k, i] += 1
                digests[i] = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in own).encode()).hexdigest()
                every = sorted([(s, k, e) for s, k, e, _ in own] + [(s, len(KINDS), e) for s, e in added])
                listed[i] = ",".join(f"{(*KINDS, 'grammar')[k]}:{s}:{e}" for s, k, e in every)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, n), pa.array(digests, pa.string()), pa.array(listed, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", sample: int = SAMPLE, limit: float = GAIN) -> DataFrame:
    """``docs`` with every secret's span replaced by ``mark``; ``n_chars`` follows. All rows and columns are kept.

    Overlapping spans are one mark; rows without spans, null and empty texts are passed on as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))

    def run(iterator):
        for batch in iterator:
            at = batch.schema.get_field_index("text")
            changed = {}
            for i, text, own, added in spans_of(batch.column(at), model.value, limit):
                out, pos = [], 0
                for s, e in sorted([(s, e) for s, _, e, _ in own] + added):
                    if e <= pos:
                        continue
                    out += [text[pos:s], mark] if s >= pos else []
                    pos = e
                changed[i] = "".join(out) + text[pos:]
            if changed:
                texts = batch.column(at).to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                c = batch.schema.get_field_index("n_chars")
                if c >= 0:
                    n = batch.column(c).to_pylist()
                    for i, t in changed.items():
                        n[i] = len(t)
                    batch = batch.set_column(c, batch.schema.field(c), pa.array(n, batch.schema.field(c).type))
            yield batch

    return map_batches(docs, run)
