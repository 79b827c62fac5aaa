"""Column statistics, histograms and interactions of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P

from .base import query


def _frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


@query("""SELECT c AS name, n, nulls, round(mean, 7) AS mean, round(sd, 7) AS sd, lo, hi FROM (
    SELECT 'l_quantity' AS c, count(*) AS n, count(*) - count(l_quantity) AS nulls, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem UNION ALL
    SELECT 'l_discount', count(*), count(*) - count(l_discount), avg(l_discount), stddev_samp(l_discount), min(l_discount), max(l_discount) FROM lineitem)""")
def profile_numeric(t):
    stats = P.profile(t.lineitem.select("l_quantity", "l_discount"))
    rows = [(k, s["rows"], s["nulls"], round(s["mean"], 7), round(s["stddev"], 7), s["min"], s["max"]) for k, s in stats.items()]
    return _frame(t.spark, rows, "name string, n long, nulls long, mean double, sd double, lo double, hi double")


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 5) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 5) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 5) FROM lineitem")
def profile_correlation(t):
    found = P.pearson(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    return _frame(t.spark, [(a, b, round(r, 5)) for (a, b), r in found.items()], "a string, b string, r double")


@query("""SELECT least(floor((l_quantity - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1""")
def profile_histogram(t):
    return P.histogram(t.lineitem, "l_quantity")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def profile_top_values(t):
    return P.top_values(t.orders, "o_orderpriority", 3)


@query("""WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT a, sum(n) AS na FROM j GROUP BY 1), y AS (SELECT b, sum(n) AS nb FROM j GROUP BY 1), s AS (SELECT sum(n) AS t FROM j)
    SELECT round(sqrt((sum(coalesce(n, 0) ** 2 / (na * nb / t)) - any_value(t)) / any_value(t) / (least((SELECT count(*) FROM x), (SELECT count(*) FROM y)) - 1)), 5) AS v FROM x CROSS JOIN y CROSS JOIN s LEFT JOIN j ON j.a = x.a AND j.b = y.b""")
def profile_cramers_v(t):
    return _frame(t.spark, [(round(P.cramers_v(t.lineitem, "l_returnflag", "l_linestatus"), 5),)], "v double")


@query("""WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT avg(l_quantity) AS m, count(*) AS n FROM lineitem)
    SELECT round((sum(g.n * (g.m - a.m) ** 2) / (count(*) - 1)) / (sum((g.n - 1) * g.v) / (any_value(a.n) - count(*))), 4) AS f FROM g, a""")
def profile_anova(t):
    return _frame(t.spark, [(round(P.anova_f(t.lineitem, "l_quantity", "l_returnflag"), 4),)], "f double")


@query()
def profile_insights(t):
    """Findings of all rules over orders, with the SQL that shows each."""
    found = P.insights(t.orders)
    return _frame(t.spark, [(str(x.get("rule")), str(x)) for x in found], "rule string, finding string")


@query("SELECT count(*) AS n, max(len(text))::BIGINT AS longest FROM documents")
def profile_text(t):
    return t.documents.agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("text")).cast("long").alias("longest"))
