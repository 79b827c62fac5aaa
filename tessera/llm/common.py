"""Session, storage and label helpers shared by the training-data operators."""

from __future__ import annotations

import threading
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.session import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, removed when the driver exits."""
    return storage.fresh(spark, tag)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files go at the end of an execution whose result is stored; they would stay until the driver's next GC."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if before is not None:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(name, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: it survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, tag)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = (out, path)
    return out


#: Frames of ``materialize`` by identity, with their paths, until ``discard`` takes them.
_stored: dict[int, tuple[DataFrame, str]] = {}
_lock = threading.Lock()


def discard(*frames: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more; other frames are passed over."""
    for frame in frames:
        with _lock:
            _, path = _stored.pop(id(frame), (None, None))
        if path:
            files, p = storage.hadoop(frame.sparkSession, path)
            files.delete(p, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_batches(df: DataFrame, run, drop: int = 0) -> DataFrame:
    """``df.mapInArrow(run, ...)`` for rows that keep their columns, all but the last ``drop``, whatever their names.

    Columns travel by place, as names with dots can't be told to a worker; ``run`` sees batches with the names.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def by_place(iterator):
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names) for b in iterator):
            yield pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])

    kept = names[: len(names) - drop]
    return plain.mapInArrow(by_place, plain.select(plain.columns[: len(kept)]).schema).toDF(*kept)


def training_ids(labels: DataFrame, column: str, value: int, bound: int, held: bool = True) -> DataFrame:
    """At most ``bound`` labelled doc_ids, those with the smallest hash, so that a broadcast of them is bounded.

    With ``held`` rows whose crc32(doc_id as text) mod 3 is 1 stay out: they are kept for evaluation.
    """
    rows = labels.where((F.col(column) == value) & F.col("doc_id").isNotNull())
    if held:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    ids = rows.select(F.col("doc_id").cast("long").alias("__id")).distinct()
    return ids.orderBy(F.xxhash64("__id"), "__id").limit(bound)


def partitions_for(spark: SparkSession, rows: int, per: int) -> int:
    """Partitions of about ``per`` rows, at least one."""
    return max(1, -(-rows // per))
