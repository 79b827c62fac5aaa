"""Window functions with the reference frame: the whole partition, unless rows are named."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def over(f: Column, partition: list[str] = (), order: list[str] = (), rows: tuple[int | None, int | None] | None = None, ranking: bool = False) -> Column:
    """``rows`` are offsets from the current row, None is unbounded; order keys as ``name`` or ``-name``."""
    w = Window.partitionBy(*partition)
    if order:
        w = w.orderBy(*[F.col(k[1:]).desc_nulls_first() if k[0] == "-" else F.col(k).asc_nulls_last() for k in order])
    elif ranking:
        w = w.orderBy(F.lit(1))
    if ranking:
        return f.over(w)
    low, high = rows or (None, None)
    return f.over(w.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high))


def nth_from_last(x: str, n: int, partition: list[str], order: list[str], ignore_nulls: bool = False) -> Column:
    """NTH_VALUE ... FROM LAST over the whole partition: the n-th in the reversed order."""
    back = [k[1:] if k[0] == "-" else f"-{k}" for k in order]
    return over(F.nth_value(x, n, ignore_nulls), partition, back)
