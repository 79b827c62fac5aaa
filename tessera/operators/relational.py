"""Joins, set operations, ordering, reshaping, sampling, folds and assertions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera import storage


def order(df: DataFrame, *keys: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Keys as ``name`` or ``-name``: nulls come last ascending and first descending."""
    df = df.orderBy(*[F.col(k[1:]).desc_nulls_first() if k[0] == "-" else F.col(k).asc_nulls_last() for k in keys])
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN: any null on the right leaves nothing, and a null key is never in the result unless the right is empty."""
    probe = right.select(F.col(other).alias("__k"))
    bad = probe.where(F.col("__k").isNull()).limit(1).select(F.lit(True).alias("__null"))
    some = probe.limit(1).select(F.lit(True).alias("__some"))
    kept = left.join(probe, left[key] == F.col("__k"), "left_anti")
    flags = F.broadcast(bad.agg(F.count(F.lit(1)).alias("__n")).join(some.agg(F.count(F.lit(1)).alias("__m")), F.lit(True)))  # one row
    return kept.join(flags, F.lit(True)).where((F.col("__n") == 0) & ((F.col("__m") == 0) | F.col(key).isNotNull())).select(*left.columns)


def range_join(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points in half-open spans, joined on cells of ``width``: each span goes to the cells that it covers."""
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    keyed = points.withColumn("__cell", F.floor(F.col(at) / width).cast("long"))
    return keyed.join(cells, "__cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """For each left row the last right row of its key at or before it, by one union and window.

    A right row is taken whole, with the nulls it has. Null keys and null times match nothing.
    """
    kept = right.dropna("any", subset=[*by, on])
    row = F.struct(*values)
    a = left.withColumns({"__row": F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType), "__left": F.lit(1)})
    b = kept.select(*by, on, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in [*by, on]], row.alias("__row"), F.lit(0).alias("__left"))
    both = a.unionByName(b.select(*a.columns))
    w = Window.partitionBy(*by).orderBy(on, "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("__row", F.last("__row", ignorenulls=True).over(w))
    return filled.where("__left = 1").select(*left.columns, *[F.col("__row")[v].alias(f"asof_{v}") for v in values])


def pivot(df: DataFrame, on: str, aggregates: list[tuple[str, str]], values: list | None = None) -> DataFrame:
    """Keys are the columns that are neither pivoted nor aggregated; without ``values`` they are found, 1000 at most."""
    keys = [c for c in df.columns if c != on and c not in {c for _, c in aggregates}]
    g = df.groupBy(*keys).pivot(on, values) if values is not None else df.groupBy(*keys).pivot(on)
    if len(aggregates) == 1:
        f, c = aggregates[0]
        return g.agg(getattr(F, f)(c))
    return g.agg(*[getattr(F, f)(c).alias(f"{f.upper()}({c})") for f, c in aggregates])


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str, include_nulls: bool = False) -> DataFrame:
    out = df.unpivot(ids, columns, name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def bernoulli(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    return df.sample(percent / 100, seed)


def stratified(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """The same chance in each stratum, which is what the keys then make no difference to."""
    return df.sample(percent / 100, seed)


def balanced(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """At most n rows of each class, drawn by a seeded random order.

    A first cut in each of 64 salts bounds what any class brings to one task by 64 * n rows.
    """
    salted = df.withColumns({"__r": F.rand(seed), "__s": F.floor(F.rand(seed + 1) * 64)})
    first = salted.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__s").orderBy("__r"))).where(F.col("__k") <= n)
    return first.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__r"))).where(F.col("__k") <= n).drop("__r", "__s", "__k")


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int = 1000) -> DataFrame:
    """UNION ALL of an anchor and the steps from it until one is empty; deeper than ``depth`` is an error.

    Every level is stored, so that a step computes from the level before it and not from the anchor again.
    """
    last = storage.stored(anchor, "recursive")
    levels = [last]
    for _ in range(depth):
        last = storage.stored(step(last), "recursive")
        if not last.take(1):
            out = levels[0]
            for level in levels[1:]:
                out = out.union(level)
            return out
        levels.append(last)
    raise RecursionError(f"more than {depth} steps")


def scan(df: DataFrame, partition: list[str], order_by: list[str], init, body, result: str, kind: str) -> DataFrame:
    """A sequential fold: state and previous row to the next state, for every row in order.

    ``init(row)`` gives the state before the first row, ``body(state, row, previous)`` the state after each;
    rows are dicts and the first has no previous row. Rows are sorted by key and order within each partition and
    streamed through in Arrow batches, so a key's rows are never held together. Without keys one task reads all.
    """
    out_type = to_arrow_type(T.DataType.fromDDL(kind))
    schema = T.StructType([*df.schema, T.StructField(result, T.DataType.fromDDL(kind))])

    def run(iterator):
        key, state, previous = None, None, None
        for batch in iterator:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in partition)
                if previous is None or own != key:
                    key, state, previous = own, init(row), None
                state = body(state, row, previous)
                previous = row
                out.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, out_type)], [*batch.schema.names, result])

    dealt = df.repartition(*[F.col(k) for k in partition]) if partition else df.coalesce(1)
    keys = [F.col(k).asc() for k in partition] + [F.col(k[1:]).desc_nulls_first() if k[0] == "-" else F.col(k).asc_nulls_last() for k in order_by]
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: float, name: str = "session_id", tie: str | None = None) -> DataFrame:
    """Numbers from 1 of runs of rows at most a gap apart: the fold as a window, with no Python."""
    w = Window.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    apart = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > gap_seconds * 1_000_000
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__new", F.when(apart | F.lag(ts).over(w).isNull(), 1).otherwise(0)).withColumn(name, F.sum("__new").over(running)).drop("__new")


def assert_rows(df: DataFrame, predicate: Column, message: str = "assertion failed", on_fail: str = "abort", observe: str = "assertions") -> DataFrame:
    """ABORT raises, SKIP drops the row, WARN counts it in an observation."""
    holds = F.coalesce(predicate, F.lit(False))
    mode = on_fail.lower()
    if mode == "skip":
        return df.where(holds)
    if mode == "warn":
        return df.observe(observe, F.sum(F.when(holds, 0).otherwise(1)).alias("failed"))
    return df.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def let(df: DataFrame, **named: Column) -> DataFrame:
    """Named values that later ones may use."""
    for k, v in named.items():
        df = df.withColumn(k, v)
    return df
