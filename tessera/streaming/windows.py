"""Event-time windows over streams, and the same over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], late: str | None = "1 hour", slide: str | None = None, **aggregates) -> DataFrame:
    """Aggregates of each window (and key); with ``slide`` the windows overlap."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = _late(df, ts, late).groupBy(w.alias("w"), *keys).agg(*[v.alias(k) for k, v in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = "1 hour", **aggregates) -> DataFrame:
    """Runs of rows of a key whose gaps are shorter than ``gap``."""
    out = _late(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*[v.alias(k) for k, v in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def drop_repeats(df: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
