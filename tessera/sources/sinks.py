"""COPY of a frame to files: Parquet, CSV, JSON, JSON lines and Arrow IPC."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera import storage

FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "arrow": "arrow", "feather": "arrow"}


def resolve(path: str, format: str | None = None) -> str:
    """The format by its name, or by the path's extension."""
    name = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if name not in FORMATS:
        raise ValueError(f"no sink for {name!r}")
    return FORMATS[name]


def _size(spark, path: str) -> int:
    files, p = storage.hadoop(spark, path)
    return files.getContentSummary(p).getLength()


def copy_to(df: DataFrame, path: str, format: str | None = None, **options) -> DataFrame:
    """Write a folder of part files, one per partition, and return one row: rows_written, bytes_written.

    Options are those of Spark's writers; ``delimiter``, ``null_string``, ``line_ending`` and ``row_group_size`` too.
    """
    spark, kind = df.sparkSession, resolve(path, format)
    named = {"delimiter": "sep", "null_string": "nullValue", "line_ending": "lineSep", "row_group_size": "parquet.block.size"}
    settings = {named.get(k, k): v for k, v in options.items()}
    seen = Observation()
    counted = df if kind == "arrow" else df.observe(seen, F.count(F.lit(1)).alias("n"))  # counted while it is written
    if kind == "arrow":
        n = _arrow(df, path)
    elif kind == "csv":
        counted.write.options(**({"header": True, "quote": '"', "escape": '"'} | ({"sep": "\t"} if path.endswith(".tsv") else {}) | settings)).csv(path)
    elif kind in ("json", "jsonl"):
        counted.write.options(**settings).json(path)
    else:
        counted.write.options(**settings).parquet(path)
    if kind != "arrow":
        n = seen.get["n"]
    return spark.range(1).select(F.lit(n).cast("long").alias("rows_written"), F.lit(_size(spark, path)).cast("long").alias("bytes_written"))


def _arrow(df: DataFrame, path: str) -> int:
    """How many rows were written. One IPC file per partition through Spark's own file systems: bytes are gathered in rows, then renamed by the driver's commit."""
    spark, tag = df.sparkSession, uuid.uuid4().hex[:8]
    files, p = storage.hadoop(spark, path)
    files.mkdirs(p)

    def run(iterator):
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(path)
        part, writer, n = TaskContext.get().partitionId(), None, 0
        name = f"{at}/part-{part:05d}-{tag}.arrow"
        sink = None
        for batch in iterator:
            if writer is None:
                sink = where.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}.tmp")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            where.move(f"{name}.{TaskContext.get().taskAttemptId()}.tmp", name)  # a repeated task replaces its file
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
