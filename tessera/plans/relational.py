"""Filters, projections, joins, set operations, ordering, subqueries, common table expressions and sampling."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from tessera import dialect
from tessera.functions import misc as M
from tessera.functions import string as S
from tessera.operators import aggregates as A
from tessera.operators import relational as R

from .base import query


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'O' AND l_discount <> 0.05""")
def filter_predicates(t):
    c = F.col
    return t.lineitem.where(c("l_quantity").between(10, 20) & c("l_returnflag").isin("A", "R") & ~(c("l_linestatus") == "O") & (c("l_discount") != 0.05)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_type ILIKE '%BRASS%' OR regexp_matches(p_brand, '^Brand#[13]') AND p_name NOT LIKE '_a%'""")
def filter_patterns(t):
    p = t.part
    return p.where((p.p_name.like("%e%") & p.p_type.ilike("%BRASS%")) | (p.p_brand.rlike("^Brand#[13]") & ~p.p_name.like("_a%"))).select("p_partkey", "p_name")


@query("SELECT count(*) AS n_null, sum(p_size)::BIGINT AS total FROM (SELECT nullif(p_size % 5, 0) AS k, p_size FROM part) WHERE k IS NULL")
def filter_is_null(t):
    return t.part.select(F.nullif(F.col("p_size") % 5, F.lit(0)).alias("k"), "p_size").where("k IS NULL").agg(F.count(F.lit(1)).alias("n_null"), F.sum("p_size").cast("long").alias("total"))


@query("SELECT * EXCLUDE (c_acctbal) REPLACE (upper(c_name) AS c_name) FROM customer")
def project_star(t):
    return t.customer.withColumn("c_name", F.upper("c_name")).drop("c_acctbal")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders""")
def case_expressions(t):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(p > 200000, "high").when(p > 100000, "mid").otherwise("low").alias("band"), F.when(s == "F", 1).when(s == "O", 2).alias("code"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross
    FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000""")
def let_bindings(t):
    rows = R.let(t.lineitem, net=F.col("l_extendedprice") * (1 - F.col("l_discount")), gross=F.col("net") * (1 + F.col("l_tax")))
    return rows.where("net > 50000").select("l_orderkey", "l_linenumber", F.round("net", 6).alias("net"), F.round("gross", 6).alias("gross"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def assert_skip(t):
    return R.assert_rows(t.orders, F.col("o_totalprice") > 1000, on_fail="skip").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders")
def assert_warn(t):
    return R.assert_rows(t.orders, F.col("o_totalprice") > 1000, on_fail="warn").select("o_orderkey")


@query("SELECT o_orderkey FROM orders")
def assert_abort(t):
    return R.assert_rows(t.orders, F.col("o_totalprice") >= 0, "a price is below 0").select("o_orderkey")


_NAMES = {"join_inner": ("inner", "JOIN"), "join_left": ("left", "LEFT JOIN"), "join_right": ("right", "RIGHT JOIN"), "join_full": ("full", "FULL JOIN")}


def _join(name: str, how: str, words: str) -> None:
    def run(t):
        o, c = t.orders.where("o_totalprice > 150000"), t.customer.where("c_acctbal > 0")
        return o.join(c, o.o_custkey == c.c_custkey, how).select("o_orderkey", "c_custkey", "c_name")

    run.__name__ = name
    query(f"""SELECT o_orderkey, c_custkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 150000) o
        {words} (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey""")(run)


for _k, (_how, _words) in _NAMES.items():
    _join(_k, _how, _words)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.crossJoin(F.broadcast(t.nation)).select("r_name", "n_name")  # the two smallest tables, of 5 and 25 rows


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def join_semi(t):
    c, o = t.customer, t.orders.where("o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def join_anti(t):
    c, o = t.customer, t.orders
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("""SELECT s.s_suppkey, count(*) AS richer FROM supplier s JOIN customer c ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal GROUP BY s.s_suppkey""")
def join_theta(t):
    """Counted by ranks, as the pairs grow with the square of a nation: those of richer bands, and those that go before in a supplier's own band."""
    c = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").cast("double").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_acctbal").cast("double").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    cuts = sorted(set(c.approxQuantile("v", [i / 256 for i in range(1, 256)], 0.001)))
    band = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x <= F.col("v"))).alias("band")
    held = c.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).select("k", "v", band, "n")
    asked = s.select("k", "v").distinct().select("k", "v", band, F.lit(None).cast("long").alias("n"))
    above = held.groupBy("k", "band").agg(F.sum("n").alias("n"))
    above = above.select("k", (F.col("band") - 1).alias("top"), F.sum("n").over(Window.partitionBy("k").orderBy(F.desc("band"))).alias("above"))
    first = Window.partitionBy("k", "band").orderBy(F.desc("v"), F.col("n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = asked.unionByName(held).withColumn("near", F.coalesce(F.sum("n").over(first), F.lit(0))).where("n IS NULL").drop("n")
    # bands without customers take the count of the next richer one
    spans = above.groupBy("k").agg(F.collect_list(F.struct("top", "above")).alias("spans"))
    more = F.coalesce(F.array_max(F.transform(F.filter("spans", lambda x: x["top"] >= F.col("band")), lambda x: x["above"])), F.lit(0))
    ranked = ranked.join(spans, "k").select("k", "v", (F.col("near") + more).alias("richer"))
    return s.join(ranked, ["k", "v"]).groupBy("s_suppkey").agg(F.sum("richer").alias("richer")).where("richer > 0")


@query("""SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""")
def join_merge(t):
    o = t.orders.where("o_orderstatus = 'P'")
    return o.join(t.lineitem.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@query("""SELECT s_suppkey, lo AS band_low, count(*) AS n FROM supplier JOIN (SELECT lo, lo + 2500 AS hi FROM (SELECT unnest([-1000.0, 1500.0, 4000.0, 6500.0, 9000.0])::DOUBLE AS lo)) ON s_acctbal >= lo AND s_acctbal < hi GROUP BY ALL""")
def join_range(t):
    spans = t.spark.createDataFrame([(float(x), float(x + 2500)) for x in (-1000, 1500, 4000, 6500, 9000)], "band_low double, band_high double")
    return R.range_join(t.supplier, "s_acctbal", spans, "band_low", "band_high", 2500.0).groupBy("s_suppkey", "band_low").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_asof(t):
    e = t.events
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.asof_join(left, right, "ts", ["user_id"], ["value"]).select("event_id", "asof_value")


@query("SELECT vec_id, pos - 1 AS pos, round(embedding[pos]::DOUBLE, 5) AS x FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS pos)")
def lateral_unnest(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("x"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
    FROM customer JOIN orders ON c_custkey = o_custkey) WHERE r <= 2""")
def lateral_top_two(t):
    return t.sql("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
        FROM {customer} JOIN {orders} ON c_custkey = o_custkey) WHERE r <= 2""", "customer", "orders")


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier"
for _name, _op in {"union_all": "UNION ALL", "union_distinct": "UNION", "intersect_distinct": "INTERSECT", "intersect_all": "INTERSECT ALL", "except_distinct": "EXCEPT", "except_all": "EXCEPT ALL"}.items():

    def _run(t, _name=_name):
        a, b = t.customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
        return {"union_all": a.union, "union_distinct": lambda x: a.union(x).distinct(), "intersect_distinct": a.intersect, "intersect_all": a.intersectAll, "except_distinct": a.subtract, "except_all": a.exceptAll}[_name](b)

    _run.__name__ = _name
    query(f"{_A} {_op} {_B}")(_run)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t):
    return R.order(t.orders.select("o_orderkey", "o_totalprice"), "-o_totalprice", "o_orderkey", limit=25)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 40 OFFSET 100")
def limit_offset(t):
    return R.order(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", limit=40, offset=100)


@query("SELECT * FROM (SELECT p_partkey, nullif(p_size % 4, 0) AS k FROM part ORDER BY k DESC NULLS FIRST, p_partkey LIMIT 30)")
def order_nulls(t):
    return R.order(t.part.select("p_partkey", F.nullif(F.col("p_size") % 4, F.lit(0)).alias("k")), "-k", "p_partkey", limit=30)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("""WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1), named AS (SELECT c_nationkey, n FROM big JOIN customer ON c_custkey = o_custkey)
    SELECT n_name, sum(n)::BIGINT AS n FROM named JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def cte_multi(t):
    return t.sql("""WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_totalprice > 100000 GROUP BY 1), named AS (SELECT c_nationkey, n FROM big JOIN {customer} ON c_custkey = o_custkey)
        SELECT n_name, sum(n) AS n FROM named JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name""", "orders", "customer", "nation")


@query("WITH RECURSIVE r(i, total) AS (SELECT 1, 1::BIGINT UNION ALL SELECT i + 1, total + i + 1 FROM r WHERE i < 60) SELECT * FROM r")
def cte_recursive(t):
    return t.spark.sql("WITH RECURSIVE r(i, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, total + i + 1 FROM r WHERE i < 60) SELECT * FROM r")


@query("SELECT i, (i * 2)::BIGINT AS x FROM (SELECT unnest(range(0, 6)) AS i)")
def recursive_frames(t):
    first = t.spark.range(1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("x"))
    return R.recursive(first, lambda r: r.where("i < 5").select((F.col("i") + 1).alias("i"), (F.col("x") + 2).alias("x")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def subquery_in(t):
    return t.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')", "orders", "customer")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def subquery_not_in(t):
    return R.not_in(t.customer, "c_nationkey", t.supplier, "s_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, (SELECT min(s_nationkey) FROM supplier)) FROM supplier)")
def subquery_not_in_null(t):
    least = t.supplier.agg(F.min("s_nationkey").alias("m"))
    k = t.supplier.join(F.broadcast(least), F.lit(True)).select(F.nullif(F.col("s_nationkey"), F.col("m")).alias("k"))  # one row is broadcast
    return R.not_in(t.customer, "c_nationkey", k, "k").select("c_custkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def subquery_exists(t):
    return t.sql("SELECT o_orderkey FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", "orders", "lineitem")


@query("SELECT c_custkey, (SELECT round(max(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def subquery_scalar(t):
    return t.sql("SELECT c_custkey, (SELECT round(max(o_totalprice), 2) FROM {orders} WHERE o_custkey = c_custkey) AS top FROM {customer}", "orders", "customer")


@query("SELECT label, least(count(*), 20) AS n FROM embeddings GROUP BY label")
def sample_balanced(t):
    return R.balanced(t.embeddings, 20, "label", seed=7).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query()
def sample_bernoulli(t):
    return R.bernoulli(t.orders, 10, seed=3).select("o_orderkey")


@query()
def sample_stratified(t):
    return R.stratified(t.orders, 10, seed=3).select("o_orderkey", "o_orderstatus")


@query()
def cross_validate(t):
    """Folds by a seeded hash of the key: the same on every run and in every engine that has XXH64."""
    return t.labels.select("doc_id", M.cross_validate_fold(5, "doc_id", seed=42).alias("fold"))


@query("""SELECT doc_id FROM documents WHERE list_has_all(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'), lambda x: true), ['license'])""")
def fulltext_match(t):
    return t.documents.where(S.tsquery_match("text", "the license")).select("doc_id")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def dialect_qualify(t):
    return dialect.sql(t.spark, "SELECT o_custkey, o_orderkey FROM {orders} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", orders=t.orders)


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice * (1 - l_discount)) ** 2 > 5000000001 AS large FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 60000")
def dialect_let(t):
    return dialect.sql(t.spark, "SELECT LET net = l_extendedprice * (1 - l_discount), l_orderkey, l_linenumber, net ^ 2 > 5000000001 AS large FROM {lineitem} WHERE net > 60000", lineitem=t.lineitem)


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS whole FROM orders")
def dialect_default_frame(t):
    return dialect.sql(t.spark, "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS whole FROM {orders}", orders=t.orders)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 5000")
def dialect_assert_skip(t):
    return dialect.sql(t.spark, "SELECT o_orderkey, o_totalprice, ASSERT o_totalprice > 5000 MESSAGE 'small' ON FAIL SKIP FROM {orders}", orders=t.orders)


@query("SELECT l_orderkey, l_linenumber, (l_linenumber::BIGINT * 7) // 2 AS whole, l_extendedprice / 2 AS part, ((l_orderkey // 3) // 2)::BIGINT AS twice FROM lineitem")
def dialect_division(t):
    """Whole numbers are divided whole, from the left."""
    return dialect.sql(t.spark, "SELECT l_orderkey, l_linenumber, l_linenumber * 7 / 2 AS whole, l_extendedprice / 2 AS part, l_orderkey / 3 / 2 AS twice FROM {lineitem}", lineitem=t.lineitem)


@query("SELECT o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def dialect_qualify_order(t):
    """Order by a column that isn't selected."""
    return dialect.sql(t.spark, "SELECT o_orderkey FROM {orders} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", orders=t.orders)


@query("SELECT count(*) AS n, 5::BIGINT AS folds, true AS even FROM orders")
def dialect_folds(t):
    """Five folds by a seed of choice hold near as many rows each."""
    folds = dialect.sql(t.spark, "SELECT o_orderkey FROM {orders} CROSS VALIDATE(5, 7) ON o_orderkey AS fold", orders=t.orders).groupBy("fold").count()
    return folds.agg(F.sum("count").alias("n"), F.count("fold").alias("folds"), (F.max("count") < 2 * F.min("count")).alias("even"))


@query("SELECT count(*) FILTER (o_totalprice <= 5000 OR o_totalprice IS NULL) AS warned, count(*) AS n FROM orders")
def dialect_assert_warn(t):
    """Failing rows pass and are counted."""
    seen = Observation()
    out = dialect.sql(t.spark, "SELECT o_orderkey, ASSERT o_totalprice > 5000 MESSAGE 'small' ON FAIL WARN FROM {orders}", warnings=seen, orders=t.orders)
    n = out.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return t.spark.range(1).select(F.lit(seen.get["warn_0"]).cast("long").alias("warned"), F.lit(n).cast("long").alias("n"))


@query("""SELECT e.event_id, a.value AS asof_value
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, CASE WHEN max(event_id) % 2 = 0 THEN NULL ELSE max(value) END AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) a ON e.user_id = a.user_id AND e.ts >= a.ts""")
def join_asof_nulls(t):
    """The last row is taken whole, also where its value is null."""
    e = t.events
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.when(F.max("event_id") % 2 == 0, F.lit(None)).otherwise(F.max("value")).alias("value"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.asof_join(left, right, "ts", ["user_id"], ["value"]).select("event_id", "asof_value")


@query("SELECT o_custkey, arg_min(o_orderkey, k) AS first_key, arg_max(o_orderkey, k) AS last_key FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS k FROM orders) GROUP BY o_custkey")
def agg_arg_nulls(t):
    """Null keys are skipped."""
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("k"))
    return rows.groupBy("o_custkey").agg(A.arg_min("o_orderkey", "k", "o_orderkey").alias("first_key"), A.arg_max("o_orderkey", "k", "o_orderkey").alias("last_key"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 5) AS off, round(l_extendedprice - l_extendedprice * l_discount, 5) AS paid FROM lineitem WHERE l_extendedprice - l_extendedprice * l_discount > 20000 AND l_quantity > 5")
def dialect_define(t):
    """A block of bindings and assertions before the list, and an assertion after the table."""
    text = "SELECT DEFINE { LET off = l_extendedprice * l_discount; LET paid = l_extendedprice - off; ASSERT paid > 20000 ON FAIL SKIP; } l_orderkey, l_linenumber, round(off, 5) AS off, round(paid, 5) AS paid FROM {lineitem} ASSERT l_quantity > 5 ON FAIL SKIP"
    return dialect.sql(t.spark, text, lineitem=t.lineitem)


@query("SELECT vec_id, round(embedding[1]::DOUBLE + embedding[2]::DOUBLE, 5) AS s, vec_id + 1 AS more FROM embeddings")
def dialect_let_parts(t):
    """Names for the places of an array and the fields of a struct."""
    return dialect.sql(t.spark, "SELECT LET (a, b) = embedding, LET {one, two} = named_struct('two', vec_id, 'one', 1), vec_id, round(CAST(a AS DOUBLE) + CAST(b AS DOUBLE), 5) AS s, two + one AS more FROM {embeddings}", embeddings=t.embeddings)
