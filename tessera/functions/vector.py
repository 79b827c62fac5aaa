"""Vector arithmetic and activations over arrays of numbers, inside the JVM but for the loops of nms and pooling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _d(x) -> Column:
    return _c(x).cast("array<double>")


def fold(v: Column, f, zero: float = 0.0) -> Column:
    return F.aggregate(v, F.lit(zero), f)


def dot_product(a, b) -> Column:
    return fold(F.zip_with(_d(a), _d(b), lambda x, y: x * y), lambda s, x: s + x)


def euclidean_distance(a, b) -> Column:
    return F.sqrt(fold(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), lambda s, x: s + x))


def manhattan_distance(a, b) -> Column:
    return fold(F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)), lambda s, x: s + x)


def hamming_distance(a, b) -> Column:
    """Places at which two texts of one length differ."""
    split = lambda s: F.split(_c(s), "")
    return fold(F.zip_with(split(a), split(b), lambda x, y: F.when(x.eqNullSafe(y), 0.0).otherwise(1.0)), lambda s, x: s + x)


def vec_norm(a, p: float = 2.0) -> Column:
    if p == 2.0:
        return F.sqrt(fold(_d(a), lambda s, x: s + x * x))
    if math.isinf(p):
        return F.array_max(F.transform(_d(a), lambda x: F.abs(x)))
    return F.pow(fold(_d(a), lambda s, x: s + F.pow(F.abs(x), F.lit(p))), F.lit(1 / p))


def cosine_similarity(a, b) -> Column:
    n = vec_norm(a) * vec_norm(b)
    return F.when(n != 0, dot_product(a, b) / n)


def l2_normalize(a) -> Column:
    return F.transform(F.arrays_zip(_d(a).alias("x"), F.array_repeat(vec_norm(a), F.size(_c(a))).alias("n")), lambda z: F.when(z["n"] != 0, z["x"] / z["n"]).otherwise(z["x"]))


def argmax(a) -> Column:
    """From 0, the first of equals."""
    return (F.array_position(_c(a), F.array_max(_c(a))) - 1).cast("int")


def argmin(a) -> Column:
    return (F.array_position(_c(a), F.array_min(_c(a))) - 1).cast("int")


def topk(a, k: int) -> Column:
    """Places of the k largest values, from 0."""
    ranked = F.array_sort(F.transform(_d(a), lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def nearest_centroid(centroids: list[list[float]], v) -> Column:
    d = F.array(*[euclidean_distance(F.array(*map(F.lit, c)), v) for c in centroids])
    return argmin(d)


def vec(*values) -> Column:
    return F.array(*[F.lit(x).cast("float") if not isinstance(x, Column) else x.cast("float") for x in values])


def vec_pad(a, length: int, fill: float = 0.0) -> Column:
    c = _c(a)
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(c)))
    return F.slice(F.concat(_d(c), more), 1, length)


def vec_repeat(a, n: int) -> Column:
    return F.flatten(F.array_repeat(_c(a), n))


def linspace(start: float, stop: float, n: int) -> Column:
    return F.array(*[F.lit(float(x)) for x in np.linspace(start, stop, n)])


def arange(start: float, stop: float, step: float = 1.0) -> Column:
    return F.array(*[F.lit(float(x)) for x in np.arange(start, stop, step)])


def vec_sum(a) -> Column:
    return fold(_d(a), lambda s, x: s + x)


def vec_mean(a) -> Column:
    return F.when(F.size(_c(a)) > 0, vec_sum(a) / F.size(_c(a)))


def vec_var(a) -> Column:
    """Of the population."""
    n = F.size(_c(a))
    sums = F.aggregate(_d(a), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda z, x: F.struct((z["s"] + x).alias("s"), (z["q"] + x * x).alias("q")))
    return F.when(n > 0, F.greatest(sums["q"] / n - (sums["s"] / n) * (sums["s"] / n), F.lit(0.0)))


def vec_std(a) -> Column:
    return F.sqrt(vec_var(a))


def vec_median(a) -> Column:
    s, n = F.array_sort(_d(a)), F.size(_c(a))
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def vec_count_nonzero(a) -> Column:
    return F.size(F.filter(_c(a), lambda x: x != 0))


def vec_any(a) -> Column:
    return F.exists(_c(a), lambda x: x != 0)


def vec_all(a) -> Column:
    return F.forall(_c(a), lambda x: x != 0)


def vec_product(a) -> Column:
    return fold(_d(a), lambda s, x: s * x, 1.0)


vec_min, vec_max, vec_concat, vec_reverse, vec_sort, vec_unique = F.array_min, F.array_max, F.concat, F.reverse, F.array_sort, F.array_distinct


def array_axpy(y, a: float, x) -> Column:
    return F.zip_with(_d(y), _d(x), lambda p, q: p + a * q)


def array_scale(a, s: float) -> Column:
    return F.transform(_d(a), lambda x: x * s)


def array_clamp(a, low: float, high: float) -> Column:
    return F.transform(_d(a), lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def array_concat_last_dim(a, a_inner: int, b, b_inner: int) -> Column:
    """Rows of two flat matrices side by side."""
    rows = F.size(_c(a)) / a_inner
    return F.flatten(F.transform(F.sequence(F.lit(0), rows.cast("int") - 1), lambda i: F.concat(F.slice(_c(a), i * a_inner + 1, a_inner), F.slice(_c(b), i * b_inner + 1, b_inner))))


def mean_pool_masked(embeddings, mask, dim: int) -> Column:
    """The mean of the rows of a flat matrix whose mask is set."""

    @F.pandas_udf("array<float>")
    def run(e: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(e, m):
            if x is None or k is None:
                out.append(None)
                continue
            rows, w = np.asarray(x, float).reshape(-1, dim), np.asarray(k, float)
            out.append((rows * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9))
        return pd.Series(out)

    return run(_c(embeddings), _c(mask))


def nms(boxes, scores, iou_threshold: float) -> Column:
    """Places of the boxes (x1, y1, x2, y2 on end) that stay after greedy suppression, best first."""

    @F.pandas_udf("array<int>")
    def run(b: pd.Series, s: pd.Series) -> pd.Series:
        def one(flat, score):
            m, order, keep = np.asarray(flat, float).reshape(-1, 4), np.argsort(-np.asarray(score, float), kind="stable"), []
            area = np.maximum(m[:, 2] - m[:, 0], 0) * np.maximum(m[:, 3] - m[:, 1], 0)
            while len(order):
                i, rest = order[0], order[1:]
                keep.append(int(i))
                w = np.maximum(0, np.minimum(m[i, 2], m[rest, 2]) - np.maximum(m[i, 0], m[rest, 0]))
                h = np.maximum(0, np.minimum(m[i, 3], m[rest, 3]) - np.maximum(m[i, 1], m[rest, 1]))
                iou = w * h / np.maximum(area[i] + area[rest] - w * h, 1e-12)
                order = rest[iou <= iou_threshold]
            return keep

        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(b, s)])

    return run(_c(boxes), _c(scores))


def pca_project(mean: list[float], components: list[list[float]], v) -> Column:
    centred = F.zip_with(_d(v), F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return F.array(*[dot_product(centred, F.array(*map(F.lit, c))) for c in components])


# Activations: of a number, or with ``array`` of each element.


def _activation(f):
    def run(x, array: bool = False) -> Column:
        return F.transform(_d(x), f) if array else f(_c(x).cast("double"))

    return run


sigmoid = _activation(lambda x: 1 / (1 + F.exp(-x)))
relu = _activation(lambda x: F.greatest(x, F.lit(0.0)))
selu = _activation(lambda x: 1.0507009873554805 * F.when(x > 0, x).otherwise(1.6732632423543772 * (F.exp(x) - 1)))
gelu = _activation(lambda x: 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x))))
swish = _activation(lambda x: x / (1 + F.exp(-x)))
softplus = _activation(lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))
softsign = _activation(lambda x: x / (1 + F.abs(x)))
mish = _activation(lambda x: x * F.tanh(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))))
hard_sigmoid = _activation(lambda x: F.least(F.greatest(x / 6 + 0.5, F.lit(0.0)), F.lit(1.0)))
hard_swish = _activation(lambda x: x * F.least(F.greatest(x / 6 + 0.5, F.lit(0.0)), F.lit(1.0)))
leaky_relu = _activation(lambda x: F.when(x > 0, x).otherwise(0.01 * x))


def elu(x, alpha: float = 1.0, array: bool = False) -> Column:
    return _activation(lambda v: F.when(v > 0, v).otherwise(alpha * (F.exp(v) - 1)))(x, array)


def _shifted(a) -> Column:
    top = F.array_max(_d(a))
    return F.transform(F.arrays_zip(_d(a).alias("x"), F.array_repeat(top, F.size(_c(a))).alias("m")), lambda z: z["x"] - z["m"])


def softmax(a) -> Column:
    e = F.transform(_shifted(a), lambda x: F.exp(x))
    return F.transform(F.arrays_zip(e.alias("x"), F.array_repeat(vec_sum(e), F.size(_c(a))).alias("s")), lambda z: z["x"] / z["s"])


def log_softmax(a) -> Column:
    s = _shifted(a)
    total = F.ln(vec_sum(F.transform(s, lambda x: F.exp(x))))
    return F.transform(F.arrays_zip(s.alias("x"), F.array_repeat(total, F.size(_c(a))).alias("t")), lambda z: z["x"] - z["t"])


def multilabel_classify(logits, labels: list[str], threshold: float = 0.5) -> Column:
    """Labels whose sigmoid reaches the threshold, with their scores."""
    known = F.array(*map(F.lit, labels))
    scored = F.transform(sigmoid(logits, array=True), lambda s, i: F.struct(F.get(known, i).alias("label"), s.alias("score")))
    return F.filter(scored, lambda z: z["score"] >= threshold)
