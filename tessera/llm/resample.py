"""Importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

The raw model counts hashed words and word pairs of all documents; the target model those of a bounded sample of
documents labelled as wanted. A document's log weight is the mean log ratio of its n-grams, times ``SHARPNESS``;
with a Gumbel variable of its doc_id added, the largest keys are a sample without replacement whose chances
follow the weights. The threshold of the top k is found exactly by radix histograms; ties go by a hash of the id.

Defined results: null and empty texts have log weight 0 and score by it; a null doc_id draws by its text; repeated
rows draw alike and share a key, so ties at the threshold are all kept; empty tables give no rows; other columns
are ignored. Without any target label the weights are 0 and the sample is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import materialize, ship, training_ids
from .ranks import split_points

BUCKETS = 1 << 16
#: Labelled documents in the target model at most.
TARGET_ROWS = 20_000
KEEP = 0.9
#: N-grams that each document counts as, whatever its length: its mean log ratio is taken so many times.
SHARPNESS = 300.0


def _grams(data: np.ndarray, offsets: np.ndarray):
    """The bucket of each word and of each pair of neighbours, and their text."""
    data = vec.LOWER[data]
    s, e, first = vec.words(data, offsets, vec.ALNUM_WORDS)
    h = vec.Hasher(data)(s, e)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    two = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    both = vec.pair(h[:-1], h[1:])[two] if len(h) else h
    bucket = np.concatenate([vec.mix(h), both]) >> np.uint64(64 - 16)
    return bucket.astype(np.int64), np.concatenate([text, text[1:][two]]) if len(text) else text


def counts(docs: DataFrame) -> np.ndarray:
    """Counts of n-grams by bucket over all rows; one row per bucket reaches the driver."""

    def run(iterator):
        total = np.zeros(BUCKETS, np.int64)
        for (text,) in vec.batches(iterator, "text"):
            data, offsets = vec.text_bytes(text)
            for i, j in vec.chunks(offsets):
                bucket, _ = _grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Per bucket; the target's counts are smoothed towards the raw model by ``prior`` n-grams a bucket on average."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    p = (raw + 1.0) / (raw.sum() + BUCKETS)
    q = (target + prior * BUCKETS * p) / (target.sum() + prior * BUCKETS)
    return np.log(q / p)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, log_weight (mean log ratio of a text's n-grams), score (its logistic), key_bits (ordered as the Gumbel keys)."""
    ratio = docs.sparkSession.sparkContext.broadcast(ratio)  # 2**16 numbers

    def run(iterator):
        for ids, draw, text in vec.batches(iterator, "doc_id", "__draw", "text"):
            data, offsets = vec.text_bytes(text)
            weight = np.zeros(len(offsets) - 1)
            for i, j in vec.chunks(offsets):
                bucket, t = _grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(t, minlength=j - i)
                weight[i:j] = np.bincount(t, ratio.value[bucket], minlength=j - i) / np.maximum(n, 1)
            u = (vec.mix(draw.to_numpy().view(np.uint64) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) + 0.5
            key = SHARPNESS * weight - np.log(-np.log(u / 2.0**53)) + 0.0
            bits = key.view(np.int64)
            bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits) >> 2  # in 62 bits
            yield pa.RecordBatch.from_arrays([ids, pa.array(weight), pa.array(1 / (1 + np.exp(-SHARPNESS * weight))), pa.array(key), pa.array(bits)], ["doc_id", "log_weight", "score", "gumbel_key", "key_bits"])

    draw = F.coalesce(F.xxhash64(F.col("doc_id").cast("long")), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).otherwise(draw).alias("__draw"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, log_weight double, score double, gumbel_key double, key_bits long")


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, target_rows: int = TARGET_ROWS, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, score, gumbel_key and kept for every row; ``keep`` of the rows are kept."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    wanted = F.broadcast(training_ids(labels, "quality", 1, target_rows))
    target = docs.join(wanted, F.col("doc_id").cast("long") == F.col("__id"), "left_semi")
    rows = materialize(weigh(docs, log_ratio(counts(target), counts(docs)), seed), "resample")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("key_bits"), F.max("key_bits")).first()
    if not n:
        return rows.select("doc_id", "log_weight", "score", "gumbel_key", F.lit(True).alias("kept"))
    k = round(keep * n)
    shift = 0 - low
    # the largest k keys: those above the key that n - k rows don't pass
    found = split_points(rows, F.lit(0), F.col("key_bits") + F.lit(shift), F.lit(1), {0: max(1, n - k + 1)}, {0: 0}, {0: high + shift}, passes=6)
    threshold = found[0][0] - shift if k else high + 1
    return rows.select("doc_id", "log_weight", "score", "gumbel_key", (F.col("key_bits") >= threshold).alias("kept"))
