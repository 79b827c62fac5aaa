"""Folders that all executors share, for tables, files and cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list = []
_local: dict = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder, which only a local session may use."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "at" not in _local:
        _local["at"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _local["at"]


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path, removed when the driver exits."""
    path = f"{root(spark)}/tessera-{tag}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """A frame read back from Parquet, so that nothing before it is computed again."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            files, p = hadoop(spark, path)
            files.delete(p, True)
        except Exception:  # the session may have ended; the cluster clears the folder then
            pass
