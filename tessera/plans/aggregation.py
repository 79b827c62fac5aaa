"""Aggregates, grouping forms, pivots and unpivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import relational as R

from .base import query


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS mean, min(l_shipdate) AS first_ship, max(l_discount) AS top
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_basic(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_shipdate").alias("first_ship"), F.max("l_discount").alias("top"))


@query("SELECT count(*) AS n, count(nullif(p_size % 3, 0)) AS some, sum(p_size)::BIGINT AS total FROM part WHERE p_size > 1000000")
def agg_global_empty(t):
    return t.part.where("p_size > 1000000").agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.col("p_size") % 3, F.lit(0))).alias("some"), F.sum("p_size").cast("long").alias("total"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers, sum(DISTINCT o_custkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus")
def agg_distinct(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("buyers"), F.sum_distinct("o_custkey").alias("keys"))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp FROM lineitem GROUP BY 1""")
def agg_stat(t):
    return t.lineitem.groupBy("l_returnflag").agg(*[F.round(f("l_quantity"), d).alias(n) for f, d, n in ((F.stddev_samp, 6, "sd"), (F.stddev_pop, 6, "sdp"), (F.var_samp, 5, "v"), (F.var_pop, 5, "vp"))])


@query("""SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS r, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs FROM lineitem GROUP BY 1""")
def agg_bivariate(t):
    x = ("l_extendedprice", "l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr(*x), 6).alias("r"), F.round(F.covar_pop(*x), 2).alias("cp"), F.round(F.covar_samp(*x), 2).alias("cs"))


@query("""SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_disc(o_totalprice, 0.25), 4) AS d25 FROM orders GROUP BY 1""")
def agg_percentile(t):
    return t.sql("""SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90,
        round(percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS d25 FROM {orders} GROUP BY o_orderstatus""", "orders")


@query("SELECT l_linestatus, quantile_disc(l_quantity, 0.5) AS med, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")
def agg_approx(t):
    return t.lineitem.groupBy("l_linestatus").agg(A.approx_median("l_quantity").alias("med"), A.approx_percentile("l_quantity", 0.9).alias("p90"))


@query("""SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS richest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY 1""")
def agg_arg(t):
    return t.customer.groupBy("c_nationkey").agg(A.arg_max("c_custkey", "c_acctbal", "c_custkey").alias("richest"), A.arg_min("c_custkey", "c_acctbal", "c_custkey").alias("poorest"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_string(t):
    return t.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "nation")


@query("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 1) AS odd FROM nation GROUP BY 1")
def agg_array(t):
    return t.nation.withColumn("x", F.when(F.col("n_nationkey") % 2 == 1, F.col("n_nationkey"))).groupBy("n_regionkey").agg(A.array_agg("x", order="n_nationkey").alias("odd"))


@query("SELECT o_custkey % 10 AS g, max(m) AS m FROM (SELECT o_custkey % 10 AS g2, o_custkey, o_orderpriority AS m FROM orders) GROUP BY 1")
def agg_max_text(t):
    return t.orders.groupBy((F.col("o_custkey") % 10).alias("g")).agg(F.max("o_orderpriority").alias("m"))


@query("""SELECT g, p AS common FROM (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY n DESC, p) AS r FROM (SELECT o_custkey % 7 AS g, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1""")
def agg_mode(t):
    """The most frequent value; of equally frequent ones the smallest, as rows have no order of their own."""
    n = t.orders.groupBy((F.col("o_custkey") % 7).alias("g"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("g").agg(F.min_by("p", F.struct(-F.col("n"), F.col("p"))).alias("common"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_by_all(t):
    return t.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL", "orders")


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS "F", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS "O" FROM lineitem GROUP BY 1""")
def pivot_single(t):
    out = R.pivot(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"), "l_linestatus", [("sum", "l_quantity")], ["F", "O"])
    return out.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def pivot_discovered(t):
    out = R.pivot(t.orders.select("o_orderpriority", "o_orderstatus", "o_orderkey"), "o_orderstatus", [("count", "o_orderkey")])
    return out.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS f_sum, count(l_quantity) FILTER (l_linestatus = 'F') AS f_n FROM lineitem GROUP BY 1""")
def pivot_two(t):
    out = R.pivot(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"), "l_linestatus", [("sum", "l_quantity"), ("count", "l_quantity")], ["F"])
    return out.select("l_returnflag", F.round("`F_SUM(l_quantity)`", 2).alias("f_sum"), F.coalesce("`F_COUNT(l_quantity)`", F.lit(0)).alias("f_n"))


@query("""SELECT p_partkey, name, value FROM (SELECT p_partkey, nullif(p_size % 3, 0)::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR name IN (size, price))""")
def unpivot_rows(t):
    wide = t.part.select("p_partkey", F.nullif(F.col("p_size") % 3, F.lit(0)).cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return R.unpivot(wide, ["p_partkey"], ["size", "price"], "name", "value")


@query("""SELECT p_partkey, name, value FROM (SELECT p_partkey, nullif(p_size % 3, 0)::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT INCLUDE NULLS (value FOR name IN (size, price))""")
def unpivot_nulls(t):
    wide = t.part.select("p_partkey", F.nullif(F.col("p_size") % 3, F.lit(0)).cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return R.unpivot(wide, ["p_partkey"], ["size", "price"], "name", "value", include_nulls=True)
