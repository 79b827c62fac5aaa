"""Importance weights against plain Python, and what they say of rows that training never saw."""

from __future__ import annotations

import math
from collections import Counter

from brute import ALNUM_WORD, AZ, held_out

from tessera.llm import resample, vec

M = (1 << 64) - 1


def mix(h: int) -> int:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor & M
    return h ^ h >> 31


def word_hash(w: bytes) -> int:
    h = sum(int(vec.BYTE_VALUES[b]) * pow(int(vec._BASE), i, 1 << 64) for i, b in enumerate(w)) + len(w) * 0xD6E8FEB86659FD93 & M
    return h or 1


def buckets(text: str | None) -> list[int]:
    h = [word_hash(w.encode()) for w in ALNUM_WORD.findall((text or "").translate(AZ))]
    pairs = [(mix(a * 0xFF51AFD7ED558CCD + b * 0xC4CEB9FE1A85EC53 + 7 & M) or 1) for a, b in zip(h, h[1:])]
    return [x >> 48 for x in map(mix, h)] + [x >> 48 for x in pairs]


def test_weights_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    wanted = {r["doc_id"] for r in labels.where("quality = 1").collect() if not held_out(r["doc_id"])}
    raw, target = Counter(), Counter()
    for i, t in text.items():
        own = buckets(t)
        raw.update(own)
        if i in wanted:
            target.update(own)
    n, m, size, prior = sum(raw.values()), sum(target.values()), resample.BUCKETS, 20.0

    def ratio(b):
        p = (raw[b] + 1) / (n + size)
        return math.log((target[b] + prior * size * p) / (m + prior * size) / p)

    for r in resample.resample(docs, labels).collect():
        own = buckets(text[r["doc_id"]])
        assert abs(r["log_weight"] - (sum(map(ratio, own)) / len(own) if own else 0.0)) < 1e-9


def test_held_out_rows_are_told_apart(spark):
    """Rows that training left out: wanted ones weigh more than the others (area under the curve)."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if held_out(r["doc_id"])}
    weight = {r["doc_id"]: r["log_weight"] for r in resample.resample(docs, labels).collect()}
    good = [weight[i] for i, q in quality.items() if q == 1]
    poor = [weight[i] for i, q in quality.items() if q == 0]
    wins = sum((g > p) + 0.5 * (g == p) for g in good for p in poor)
    assert len(good) > 20 and len(poor) > 5
    assert wins / (len(good) * len(poor)) > 0.7
