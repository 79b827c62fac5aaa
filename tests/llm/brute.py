"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter

import xxhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def simhash(text: str | None) -> str:
    words = BLANK_WORD.findall((text or "").translate(AZ))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return f"{sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)):016x}"


def components(rows: list[tuple[int, str]]) -> dict[int, int]:
    """Smallest doc_id reachable over fingerprints at two or fewer differing bits."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    number = [int(f, 16) for f in prints]
    for i in range(len(prints)):
        for j in range(i + 1, len(prints)):
            if (number[i] ^ number[j]).bit_count() <= 2:
                parent[root(prints[j])] = root(prints[i])
    least: dict[str, int] = {}
    for d, f in rows:
        least[root(f)] = min(d, least.get(root(f), d))
    return {d: least[root(f)] for d, f in rows}


def quality_base(text: str | None) -> dict:
    text = text or ""
    words = BLANK_WORD.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
    return out | {"base_failed": len(words) < 20 or 100 * len(hit) > 30 * len(words)}


def licenses_base(text: str | None) -> dict:
    words = ALNUM_WORD.findall((text or "").translate(AZ))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(labels))}


def secrets_base(text: str | None) -> dict:
    text, spans = text or "", []
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = [("assign", assign, lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    n = {}
    for k, (kind, pattern, good) in enumerate(rules):
        own = [m for m in re.finditer(pattern, text) if good(m)]
        n[f"n_{kind}"] = len(own)
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in own]
    return n | {"base_sha256": hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest()}


def contamination(texts: dict, items: dict) -> dict:
    """Per document id: n_words, n_hit, n_items, items_sha256, contaminated."""
    windows: dict[tuple, set] = {}
    for i, t in items.items():
        w = ALNUM_WORD.findall((t or "").translate(AZ))
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for d, t in texts.items():
        w = ALNUM_WORD.findall((t or "").translate(AZ))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    found |= own
                    hit.update(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def crc_ids(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def pieces(ids: list[int], size: int = 1024) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = (len(ids) - 1) % size + 1
    cuts = [0, *range(first, len(ids) + 1, size)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def show(x) -> str:
    return json.dumps(x, default=str)
