"""Queries of the engine's own operators, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregation, analysis, files, library, media, relational, scalars, vectors, windowing  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES


def flagship(spark, sf_dir: str) -> DataFrame:
    """Revenue and lines by order priority: scan, filter, equi-join, aggregation and order."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate < TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("o_orderpriority").agg(revenue.alias("revenue"), F.count(F.lit(1)).alias("lines")).orderBy("o_orderpriority")


FLAGSHIP_SQL = """SELECT o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < TIMESTAMP '1998-09-02'
    GROUP BY o_orderpriority ORDER BY o_orderpriority"""


def queries() -> dict:
    return {"flagship": flagship} | QUERIES


def oracle_sql() -> dict[str, str]:
    return {"flagship": FLAGSHIP_SQL} | ORACLES
