"""Aggregates whose rules differ from Spark's: ties, empties, and fits over vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def array_agg(x, order=None) -> Column:
    """Nulls are skipped; null if nothing is left."""
    c = F.col(x) if isinstance(x, str) else x
    if order is None:
        out = F.collect_list(c)
    else:
        out = F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(order).alias("k"), c.alias("v"))))), lambda s: s["v"])
    return F.when(F.size(out) > 0, out)


def arg_max(v, k, row) -> Column:
    """The value at the largest key; of equals the first row. Null keys are skipped."""
    return F.max_by(F.col(v), F.when(F.col(k).isNotNull(), F.struct(F.col(k), -F.col(row))))


def arg_min(v, k, row) -> Column:
    """The value at the smallest key; of equals the first row. Null keys are skipped."""
    return F.min_by(F.col(v), F.when(F.col(k).isNotNull(), F.struct(F.col(k), F.col(row))))


def approx_percentile(x, fraction: float, accuracy: int = 1_000_000) -> Column:
    return F.percentile_approx(x, fraction, accuracy).cast("double")


def approx_median(x) -> Column:
    return approx_percentile(x, 0.5)


def string_agg(x, separator: str) -> Column:
    return F.listagg(x, F.lit(separator))


def kmeans_fit_agg(k: int, max_iter: int = 100, tol: float = 1e-4, seed: int = 42):
    """A grouped aggregate of vectors: centroids, inertia and iterations of Lloyd's method from k-means++ seeds.

    Each group is fitted in one task.
    """

    def run(pdf: pd.DataFrame, key: tuple, names: list[str], column: str) -> pd.DataFrame:
        x = np.array([v for v in pdf[column] if v is not None], float)
        if len(x) < k:
            raise ValueError("fewer vectors than clusters")
        rng = np.random.default_rng(seed)
        c = [x[rng.integers(len(x))]]
        while len(c) < k:
            d = np.min([((x - y) ** 2).sum(axis=1) for y in c], axis=0)
            c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
        c = np.array(c)
        for turn in range(1, max_iter + 1):
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            new = np.array([x[own == j].mean(axis=0) if (own == j).any() else x[d.min(axis=1).argmax()] for j in range(k)])
            moved = np.abs(new - c).max()
            c = new
            if moved < tol:
                break
        inertia = float(((x - c[((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)]) ** 2).sum())
        return pd.DataFrame([dict(zip(names, key)) | {"centroids": c.tolist(), "inertia": inertia, "iterations": turn}])

    return run


def kmeans_fit(df, by: list[str], column: str, k: int, **options):
    f = kmeans_fit_agg(k, **options)
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    schema = ", ".join(filter(None, [kinds, "centroids array<array<double>>, inertia double, iterations int"]))
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.applyInPandas(lambda key, pdf: f(pdf, key, by, column), schema)


def pca_fit(df, column: str, k: int, dims: int) -> dict:
    """Mean, components and variance shares from one distributed pass of sums and products of ``dims`` columns."""
    v = [F.get(F.col(column), F.lit(i)).cast("double") for i in range(dims)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(v)]
    products = [F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i in range(dims) for j in range(i, dims)]
    r = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n"), *sums, *products).first()
    n, mean = r["n"], np.array([r[f"s{i}"] for i in range(dims)]) / r["n"]
    cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(dims)] for i in range(dims)]) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:k]
    components = vectors[:, top].T
    components *= np.sign(components[np.arange(len(top)), np.abs(components).argmax(axis=1)])[:, None]
    return {"mean": mean.tolist(), "components": components.tolist(), "variance_ratio": (values[top] / values.sum()).tolist()}
