"""Exact ids of a byte-level BPE tokenizer file, encoded by whole batches.

The pre-tokenizer's split is computed on arrays of code points, each distinct pre-token is encoded once per
worker, and ids are gathered from that cache. Character classes are taken from the tokenizers library itself.
Texts with code points beyond the table are encoded by the library. New pre-tokens are encoded with the file's
own ranks; the first of them in each worker are compared with the library, and a difference is an error.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from . import vec

LIMIT = 0x2E80
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
CHECKED = 256
CACHED = 1 << 20
_CODE_VALUES = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, LIMIT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SUFFIX = [("s", 1), ("t", 1), ("m", 1), ("d", 1), ("re", 2), ("ve", 2), ("ll", 2)]


def _classes(pre) -> np.ndarray:
    """The class of each code point, by how the library splits it from a letter, a digit or a sign."""
    table = np.full(LIMIT, OTHER, np.uint8)
    points = [c for c in range(LIMIT) if not 0xD800 <= c < 0xE000]
    for c in points:
        ch = chr(c)
        if len(pre("a" + ch)) == 1:
            table[c] = LETTER
        elif len(pre("1" + ch)) == 1:
            table[c] = NUMBER
        elif len(pre("!" + ch)) != 1:
            table[c] = BLANK
    return table


@lru_cache(maxsize=2)
def encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normaliser is needed")
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.classes = _classes(self.library.pre_tokenizer.pre_tokenize_str)
        self.checked = 0
        self._clear()

    def _clear(self) -> None:
        self.table = vec.Table(16)
        self.at, self.count, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.used = self.filled = 0

    def _starts(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens start."""
        n = len(cp)
        cls = self.classes[cp]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        run = np.ones(n, bool)
        run[1:] = (cls[1:] != cls[:-1]) | first[1:n]
        blank = cls == BLANK
        after = np.zeros(n, bool)  # a space just before, in the same text
        after[1:] = (cp[:-1] == 32) & ~first[1:n]
        last = np.zeros(n, bool)  # the last blank before something else
        last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
        start = np.where(blank, run | last, run & ~after)
        quote = np.flatnonzero((cp == 39) & start & run)
        for i in quote.tolist():
            if i + 1 >= n or first[i + 1] or cls[i + 1] != LETTER:
                continue
            for tail, k in _SUFFIX:
                if i + k < n and not first[i + 1 : i + k + 1].any() and all(cp[i + 1 + j] == ord(t) for j, t in enumerate(tail)):
                    start[i + 1] = False
                    if i + k + 1 < n and not first[i + k + 1] and cls[i + k + 1] == LETTER:
                        start[i + k + 1] = True
                    break
        return np.flatnonzero(start)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if self.used + len(keys) > CACHED and self.used:
            raise _Full
        ids = [self.core.encode_single_piece(p.encode()) for p in pieces]
        if self.checked < CHECKED:
            some = [i for i in range(min(len(pieces), CHECKED - self.checked)) if not any(s in pieces[i] for s in self.special)]
            for i, e in zip(some, self.library.encode_batch([pieces[i] for i in some], add_special_tokens=False)):
                if e.ids != ids[i]:
                    raise ValueError(f"the ranks and the library differ on {pieces[i]!r}")
            self.checked += len(some)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        more, need = int(sizes.sum()), self.used + len(ids)
        while need > len(self.at):
            self.at, self.count = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.count, np.zeros_like(self.count)])
        while self.filled + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled : self.filled + more] = np.fromiter((x for y in ids for x in y), np.uint32, more)
        self.at[self.used : need] = self.filled + np.cumsum(sizes) - sizes
        self.count[self.used : need] = sizes
        self.table.put(keys, np.arange(self.used, need, dtype=np.int32))
        self.used, self.filled = need, self.filled + more

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        odd = {}
        whole = "".join(texts)
        far = not whole.isascii() and int(np.frombuffer(whole.encode("utf-32-le"), np.uint32).max()) >= LIMIT
        if far or any(s in whole for s in self.special):
            for i, t in enumerate(texts):
                if not t.isascii() and max(t) >= chr(LIMIT) or any(s in t for s in self.special):
                    odd[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        plain = ["" if i in odd else t for i, t in enumerate(texts)] if odd else texts
        flat, counts = self._plain(plain)
        if odd:
            parts, ends = [], np.cumsum(counts)
            for i, (e, c) in enumerate(zip(ends.tolist(), counts.tolist())):
                parts.append(odd.get(i, flat[e - c : e]))
            counts = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts) if parts else flat
        return flat, counts

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = self._starts(cp, offsets)
        ends = np.append(starts[1:], len(cp))
        h = vec.Hasher(cp, _CODE_VALUES)(starts, ends)
        entry = self.table.get(h)
        missed = np.flatnonzero(entry < 0)
        if len(missed):
            keys, one = np.unique(h[missed], return_index=True)
            pieces = [whole[a:b] for a, b in zip(starts[missed[one]].tolist(), ends[missed[one]].tolist())]
            try:
                self._learn(keys, pieces)
            except _Full:
                self._clear()
                keys, one = np.unique(h, return_index=True)
                self._learn(keys, [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])
                missed = np.arange(len(h))
            entry[missed] = self.table.get(h[missed])
        sizes = self.count[entry].astype(np.int64)
        stop = np.cumsum(sizes)
        where = np.repeat(self.at[entry] - (stop - sizes), sizes)
        where += np.arange(len(where))
        per_text = np.concatenate([[0], stop])[np.searchsorted(starts, offsets, "left")]
        return self.flat[where], np.diff(per_text)


class _Full(Exception):
    pass


def encoded(column, path: str, limit: int = 1 << 20):
    """(first row, texts' counts, ids) for pieces of an Arrow text column; a null is an empty text."""
    _, offsets = vec.text_bytes(column)
    e = encoder(path)
    for i, j in vec.chunks(offsets, limit):
        texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
        flat, counts = e.encode(texts)
        yield i, counts, flat
