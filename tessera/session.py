"""A session with the engine's settings."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.pivotMaxValues": "1000",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, unless PYTHONPATH has it."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(context.applicationId)
    at = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(at))


def builder(name: str = "tessera") -> SparkSession.Builder:
    b = SparkSession.builder.appName(name)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b
