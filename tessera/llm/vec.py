"""Words of many texts at once, on the UTF-8 bytes of an Arrow column, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words by white space only.
BLANK_WORDS = ~SPACE
#: Words of digits, letters and everything beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0}


def powers(n: int):
    """base**i and base**-i modulo 2**64 for i < n."""
    if _powers["n"] < n:
        n = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


class Hasher:
    """64-bit hashes of any slices of one byte (or code point) array, through prefix sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return np.where(h == 0, np.uint64(1), h)


def hash_word(word: bytes) -> int:
    a = np.frombuffer(word, np.uint8)
    return int(Hasher(a)(np.array([0]), np.array([len(a)]))[0])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    h = mix(a * np.uint64(0xFF51AFD7ED558CCD) + b * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(7))
    return np.where(h == 0, np.uint64(1), h)


class Table:
    """Open addressing from non-zero 64-bit keys to int32 values, looked up by whole arrays."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        slot, mask = self._slot(h), (1 << self.bits) - 1
        k = self.keys[slot]
        hit = k == h
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (k != 0))
        while len(left):
            s = slot[left] = (slot[left] + 1) & mask
            k = self.keys[s]
            hit = k == h[left]
            out[left[hit]] = self.values[s[hit]]
            left = left[~hit & (k != 0)]
        return out

    def put(self, h: np.ndarray, v: np.ndarray) -> None:
        """Add keys that are distinct and new."""
        if 2 * (self.size + len(h)) > 1 << self.bits:
            old, keep = self.keys, self.keys != 0
            k, w = old[keep], self.values[keep]
            while 2 * (self.size + len(h)) > 1 << self.bits:
                self.bits += 1
            self.size, self.keys, self.values = 0, np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self.put(k, w)
        slot, mask, left = self._slot(h), (1 << self.bits) - 1, np.arange(len(h))
        while len(left):
            s = slot[left]
            free = np.flatnonzero(self.keys[s] == 0)
            _, one = np.unique(s[free], return_index=True)
            won = free[one]
            self.keys[s[won]], self.values[s[won]] = h[left[won]], v[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left = left[rest]
            taken = self.keys[slot[left]] != 0
            slot[left[taken]] = (slot[left[taken]] + 1) & mask
        self.size += len(h)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges [i, j) of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends of all words, and per text the index of its first word (and their count at last)."""
    n = len(data)
    inside = table[data] if n else np.zeros(0, bool)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def batches(iterator, *names):
    """Columns of Arrow batches by name, in pieces that keep working memory small."""
    for batch in iterator:
        yield [batch.column(batch.schema.get_field_index(x)) for x in names]
