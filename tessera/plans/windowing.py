"""Window functions, frames, qualified rows, ordered folds and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.operators import relational as R
from tessera.operators import windows as W

from .base import query

KEY, BY = ["o_custkey"], ["o_orderdate", "o_orderkey"]
OVER = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
ALL = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"SELECT o_orderkey, row_number() OVER {OVER} AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(3) OVER {OVER} AS nt FROM orders")
def window_rank(t):
    c = lambda f, o: W.over(f, KEY, o, ranking=True).cast("long")
    return t.orders.select("o_orderkey", c(F.row_number(), BY).alias("rn"), c(F.rank(), ["o_orderstatus"]).alias("rk"), c(F.dense_rank(), ["o_orderstatus"]).alias("dr"), c(F.ntile(3), BY).alias("nt"))


@query(f"SELECT o_orderkey, lag(o_totalprice) OVER {OVER} AS before, lead(o_totalprice, 2, -1.0) OVER {OVER} AS after FROM orders")
def window_offset(t):
    return t.orders.select("o_orderkey", W.over(F.lag("o_totalprice"), KEY, BY, ranking=True).alias("before"), W.over(F.lead("o_totalprice", 2, -1.0), KEY, BY, ranking=True).alias("after"))


@query(f"SELECT o_orderkey, first_value(o_totalprice) OVER {ALL} AS f, last_value(o_totalprice) OVER {ALL} AS l, nth_value(o_totalprice, 2) OVER {ALL} AS second FROM orders")
def window_value(t):
    return t.orders.select("o_orderkey", *[W.over(f, KEY, BY).alias(n) for f, n in ((F.first("o_totalprice"), "f"), (F.last("o_totalprice"), "l"), (F.nth_value("o_totalprice", 2), "second"))])


@query(f"SELECT o_orderkey, first_value(x IGNORE NULLS) OVER {ALL} AS f, last_value(x IGNORE NULLS) OVER {ALL} AS l FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS x FROM orders)")
def window_ignore_nulls(t):
    rows = t.orders.withColumn("x", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return rows.select("o_orderkey", W.over(F.first("x", ignorenulls=True), KEY, BY).alias("f"), W.over(F.last("x", ignorenulls=True), KEY, BY).alias("l"))


@query("SELECT o_orderkey, nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_but_one FROM orders")
def window_from_last(t):
    return t.orders.select("o_orderkey", W.nth_from_last("o_totalprice", 2, KEY, BY).alias("last_but_one"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
    round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS sliding,
    count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM orders""")
def window_frames(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(W.over(F.sum(p), KEY, BY, (None, 0)), 2).alias("running"), F.round(W.over(F.avg(p), KEY, BY, (-2, 1)), 4).alias("sliding"), W.over(F.count(F.lit(1)), KEY, BY, (1, None)).alias("later"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS whole FROM orders")
def window_whole_partition(t):
    return t.orders.select("o_orderkey", F.round(W.over(F.sum("o_totalprice"), KEY, BY), 2).alias("whole"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def qualify(t):
    r = W.over(F.row_number(), KEY, ["-o_totalprice", "o_orderkey"], ranking=True)
    return t.orders.select("o_custkey", "o_orderkey", r.alias("r")).where("r <= 3").drop("r")


@query("""SELECT event_id, (1 + sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_id FROM
    (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS n FROM events)""")
def scan_sessions(t):
    e = t.events.select("event_id", "user_id", "ts")
    return R.sessions(e, "user_id", "ts", 3600, tie="event_id").select("event_id", F.col("session_id").cast("long").alias("session_id"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderdate, o_orderkey) AS streak FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS i0,
     concat(o_orderstatus, i0) AS island FROM orders)""")
def scan_streak(t):
    """A fold with the previous row: how many orders on end had the status of this one."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    out = R.scan(rows, KEY, BY, lambda row: 0, lambda state, row, before: state + 1 if before and before["o_orderstatus"] == row["o_orderstatus"] else 1, "streak", "long")
    return out.select("o_orderkey", "streak")


@query(f"SELECT o_orderkey, floor(list_reduce(list(o_totalprice) OVER {OVER[:-1]} ROWS UNBOUNDED PRECEDING), lambda a, x: 0.7 * a + 0.3 * x) + 0.00001234)::BIGINT AS ema FROM orders")
def scan_ema(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = R.scan(rows, KEY, BY, lambda row: row["o_totalprice"], lambda s, row, before: 0.7 * s + 0.3 * row["o_totalprice"], "ema", "double")
    return out.select("o_orderkey", F.floor(F.col("ema") + 0.00001234).alias("ema"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def window_tumbling(t):
    start = T.date_bin(6 * T.HOUR, "ts", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return t.events.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, ts FROM events) GROUP BY 1""")
def window_sliding(t):
    w = F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour")
    return t.events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT d.day AS day, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-03-31', INTERVAL 1 DAY)) AS day) d LEFT JOIN orders ON date_trunc('day', o_orderdate) = d.day GROUP BY 1""")
def gap_filling(t):
    days = t.spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'1995-01-01', TIMESTAMP_NTZ'1995-03-31', INTERVAL 1 DAY)) AS day")
    o = t.orders.select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("d"), "o_orderkey")
    return days.join(o, days.day == o.d, "left").groupBy("day").agg(F.count("o_orderkey").alias("n"))
