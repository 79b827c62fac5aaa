"""Sources, sinks, generated rows and tables that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import storage, tables
from tessera.sources import readers, sinks
from tessera.streaming import windows

from .base import query

_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000"


def _few(t):
    return t.orders.where("o_totalprice > 100000").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _round_trip(name: str, extension: str, read) -> None:
    def run(t):
        path = storage.fresh(t.spark, name) + f".{extension}"
        sinks.copy_to(_few(t), path)
        return read(t.spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", "o_totalprice")

    run.__name__ = name
    query(_ORDERS)(run)


_round_trip("copy_parquet", "parquet", readers.open_parquet)
_round_trip("copy_csv", "csv", lambda s, p: readers.open_csv_typed(s, p, ",", True))
_round_trip("copy_jsonl", "jsonl", readers.open_jsonl)
_round_trip("copy_arrow", "arrow", readers.open_arrow)


@query("SELECT count(*) AS rows_written, true AS some_bytes FROM orders WHERE o_totalprice > 100000")
def copy_summary(t):
    done = sinks.copy_to(_few(t), storage.fresh(t.spark, "copy") + ".csv")
    return done.select("rows_written", (F.col("bytes_written") > 0).alias("some_bytes"))


@query("SELECT [o_orderkey::VARCHAR, o_orderstatus] AS fields FROM orders WHERE o_totalprice > 100000")
def csv_fields(t):
    path = storage.fresh(t.spark, "fields") + ".csv"
    sinks.copy_to(_few(t).select("o_orderkey", "o_orderstatus"), path, header=False)
    return readers.open_csv(t.spark, path, ",")


@query("SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice']) AS column_name, unnest(['bigint', 'string', 'double']) AS element_kind, false AS is_array, true AS nullable")
def parquet_meta(t):
    path = storage.fresh(t.spark, "meta") + ".parquet"
    sinks.copy_to(_few(t), path)
    return readers.open_parquet_meta(t.spark, path)


@query("SELECT unnest(generate_series(1, 20, 3))::BIGINT AS value UNION ALL SELECT unnest(range(5, 9))::BIGINT")
def series(t):
    return readers.generate_series(t.spark, 1, 20, 3).union(readers.range_(t.spark, 5, 9))


@query("SELECT vec_id, unnest(embedding)::DOUBLE > 0 AS positive FROM embeddings")
def unnest_array(t):
    return t.embeddings.select("vec_id", F.explode("embedding").alias("x")).select("vec_id", (F.col("x") > 0).alias("positive"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END::DOUBLE AS o_totalprice FROM orders
    WHERE o_totalprice > 100000 AND NOT (o_orderstatus = 'O' AND o_totalprice < 200000) UNION ALL SELECT -1, 'N', 7.5""")
def table_changes(t):
    """INSERT, UPDATE and DELETE, each a version of the table."""
    table = tables.Table.create(t.spark, storage.fresh(t.spark, "table"), _few(t), tables.Rules(primary_key=["o_orderkey"]))
    table.delete("o_orderstatus = 'O' AND o_totalprice < 200000")
    table.update("o_orderstatus = 'P'", o_orderstatus="'X'", o_totalprice="0D")
    table.insert(t.spark.createDataFrame([(-1, "N", 7.5)], "o_orderkey long, o_orderstatus string, o_totalprice double"))
    return table.read()


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t):
    """Hourly counts by a stream of the table, run to its end."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    rows = windows.tumbling(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 hour", ["event_type"], late=None, n=F.count(F.lit(1)))
    path = storage.fresh(t.spark, "stream")

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    done = rows.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    done.awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
