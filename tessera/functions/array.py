"""Array functions. Tensors of several dimensions are structs of a flat array and its shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def array_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def array_avg(a) -> Column:
    return F.when(F.size(_c(a)) > 0, array_sum(a) / F.size(_c(a)))


def array_concat(a, b, kind: str = "array<double>") -> Column:
    """A null is an empty array."""
    none = F.array().cast(kind)
    return F.concat(F.coalesce(_c(a), none), F.coalesce(_c(b), none))


def array_get(a, *at: int) -> Column:
    """From 1; of a tensor one index per dimension."""
    c = _c(a)
    if len(at) == 1:
        return F.try_element_at(c, F.lit(at[0]))
    place = F.lit(0)
    for d, i in enumerate(at):
        place = place * F.get(c["shape"], F.lit(d)) + (i - 1)
    return F.get(c["data"], place)


def tensor(data, *shape: int) -> Column:
    return F.struct(_c(data).alias("data"), F.array(*map(F.lit, shape)).alias("shape"))


def array_shape(a, is_tensor: bool = False) -> Column:
    return _c(a)["shape"] if is_tensor else F.array(F.size(_c(a)))


def array_ndims(a, is_tensor: bool = False) -> Column:
    return F.size(_c(a)["shape"]) if is_tensor else F.lit(1)


def array_length(a, dim: int = 1, is_tensor: bool = False) -> Column:
    return F.get(_c(a)["shape"], F.lit(dim - 1)) if is_tensor else F.size(_c(a))


def array_position(a, value) -> Column:
    """Null where there is none."""
    return F.nullif(F.array_position(_c(a), value).cast("long"), F.lit(0).cast("long"))


def array_slice(a, start: int, length: int) -> Column:
    return F.slice(_c(a), start, length)


def array_to_string(a, delimiter: str, null_string: str | None = None) -> Column:
    return F.array_join(_c(a), delimiter, null_string) if null_string is not None else F.array_join(_c(a), delimiter)


def random_choice(a, seed: int | None = None) -> Column:
    return F.get(F.shuffle(_c(a), seed) if seed is not None else F.shuffle(_c(a)), F.lit(0))


def array_resize_2d(a, source: tuple[int, int], goal: tuple[int, int]) -> Column:
    """Bilinear resampling of a flat row-major array of height times width values."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        (h, w), (gh, gw) = source, goal
        y, x = (np.clip((np.arange(g) + 0.5) * n / g - 0.5, 0, n - 1) for g, n in ((gh, h), (gw, w)))
        y0, x0 = y.astype(int), x.astype(int)
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None]

        def one(v):
            if v is None:
                return None
            m = np.asarray(v, float).reshape(h, w)
            return ((m[y0][:, x0] * (1 - fx) + m[y0][:, x1] * fx) * (1 - fy) + (m[y1][:, x0] * (1 - fx) + m[y1][:, x1] * fx) * fy).ravel()

        return s.map(one)

    return run(_c(a))


array, array_contains, array_distinct, array_filter, array_flatten = F.array, F.array_contains, F.array_distinct, F.filter, F.flatten
array_max, array_min, array_repeat, array_reverse, array_shuffle = F.array_max, F.array_min, F.array_repeat, F.reverse, F.shuffle
array_sort, array_transform, cardinality = F.array_sort, F.transform, F.cardinality
vec_slice, array_join = array_slice, array_to_string
