"""Numeric functions whose rules differ from Spark's own; the rest are Spark's built-in ones under their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def each(x: Column, f, array: bool = False) -> Column:
    """A scalar function over a value or over each element of an array."""
    return F.transform(x, f) if array else f(x)


def clamp(x, low, high, array: bool = False) -> Column:
    return each(_c(x), lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)), array)


def quantize(x, step, array: bool = False) -> Column:
    return each(_c(x), lambda v: F.round(v / step) * step, array)


def bucketize(x, boundaries: list) -> Column:
    """How many boundaries are at or below the value."""
    return F.size(F.filter(F.array(*map(F.lit, boundaries)), lambda b: b <= _c(x)))


def is_finite(x) -> Column:
    return ~F.isnan(_c(x).cast("double")) & (F.abs(_c(x).cast("double")) != float("inf"))


def is_infinite(x) -> Column:
    return F.abs(_c(x).cast("double")) == float("inf")


def is_nan(x) -> Column:
    return F.isnan(_c(x).cast("double"))


def min_max_normalize(x, low, high, array: bool = False) -> Column:
    return each(_c(x), lambda v: (v - low) / (high - low), array)


def denormalize(x, low, high, array: bool = False) -> Column:
    return each(_c(x), lambda v: v * (high - low) + low, array)


def negate(x) -> Column:
    return -_c(x)


def square(x) -> Column:
    return _c(x) * _c(x)


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), _c(x))


def log(x, base) -> Column:
    """The value comes first."""
    return F.ln(_c(x)) / F.ln(F.lit(float(base)))


def truncate(x) -> Column:
    c = _c(x)
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def int_divide(a, b) -> Column:
    """Whole division of integers towards zero."""
    q = _c(a) / _c(b)
    return truncate(q).cast("long")


for _name in ("abs", "ceil", "floor", "greatest", "least", "cbrt", "exp", "ln", "log2", "log10", "pow", "round", "sqrt", "sin", "cos", "tan", "cot", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "degrees", "radians", "pi"):
    globals()[_name] = getattr(F, _name)
sign, ceiling, trunc, clip, isnan, isfinite, euler = F.signum, F.ceil, truncate, clamp, is_nan, is_finite, F.e
