"""String, number, time, array, JSON, hash, UUID, path and assertion functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import array as A
from tessera.functions import math as N
from tessera.functions import misc as M
from tessera.functions import string as S
from tessera.functions import temporal as T

from .base import query


@query("""SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name)::BIGINT AS n, strlen(p_name)::BIGINT AS bytes, reverse(p_brand) AS r, repeat(p_brand, 2) AS twice,
    lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, replace(p_type, ' ', '_') AS rep, p_brand || '/' || p_type AS both, ascii(p_name) AS first, translate(p_name, 'aeiou', '12345') AS tr FROM part""")
def string_basic(t):
    c = F.col
    return t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), F.char_length("p_name").cast("long").alias("n"), F.octet_length("p_name").cast("long").alias("bytes"), F.reverse("p_brand").alias("r"), F.repeat("p_brand", 2).alias("twice"),
        F.lpad("p_brand", 12, "*").alias("lp"), F.rpad("p_brand", 12, "*").alias("rp"), F.replace(c("p_type"), F.lit(" "), F.lit("_")).alias("rep"), S.concat_strict("p_brand", F.lit("/"), "p_type").alias("both"), F.ascii("p_name").alias("first"), F.translate("p_name", "aeiou", "12345").alias("tr"))


@query("""SELECT p_partkey, left(p_name, 4) AS a, left(p_name, -3) AS b, right(p_name, 4) AS c, right(p_name, -3) AS d, substring(p_name, 2, 3) AS e, substring(p_name, 1, 2) AS f,
    strpos(p_name, 'e')::INT AS g, split_part(p_type, ' ', 2) AS h, trim(p_brand, 'B#') AS i, ltrim(p_brand, 'Bra') AS j, rtrim(p_brand, '123') AS k, starts_with(p_name, 'l') AS m, p_name LIKE '%e' AS o FROM part""")
def string_slices(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", S.left(n, 4).alias("a"), S.left(n, -3).alias("b"), S.right(n, 4).alias("c"), S.right(n, -3).alias("d"), S.substring(n, 2, 3).alias("e"), S.substring(n, 0, 3).alias("f"),
        S.position(n, "e").alias("g"), S.split_part("p_type", " ", 2).alias("h"), S.trim("p_brand", "B#").alias("i"), S.ltrim("p_brand", "Bra").alias("j"), S.rtrim("p_brand", "123").alias("k"), n.startswith("l").alias("m"), n.endswith("e").alias("o"))


@query("""SELECT p_partkey, concat('x', nullif(p_brand, 'Brand#11'), 'y') AS c, concat_ws('-', p_brand, p_type) AS w, 'x' || nullif(p_brand, 'Brand#11') AS s FROM part""")
def string_concat(t):
    b = F.nullif(F.col("p_brand"), F.lit("Brand#11"))
    return t.part.select("p_partkey", S.concat(F.lit("x"), b, F.lit("y")).alias("c"), F.concat_ws("-", "p_brand", "p_type").alias("w"), S.concat_strict(F.lit("x"), b).alias("s"))


@query("""SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}') AS l, len(regexp_extract_all(p_name, '[aeiou]'))::BIGINT AS n, regexp_replace(p_name, '[aeiou]', '_') AS one, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every,
    CASE WHEN regexp_matches(p_brand, '#\\d') THEN regexp_extract(p_brand, '#(\\d)', 1) END AS g, string_split_regex(p_type, '[ ]+') AS parts, regexp_extract_all(p_name, '[a-z]+')[2] AS second FROM part""")
def string_regexp(t):
    n = "p_name"
    return t.part.select("p_partkey", S.regexp_like(n, "[aeiou]{2}").alias("l"), S.regexp_count(n, "[aeiou]").cast("long").alias("n"), S.regexp_replace(n, "[aeiou]", "_").alias("one"), S.regexp_replace(n, "[aeiou]", "_", "g").alias("every"),
        S.regexp_extract("p_brand", r"#(\d)", 1).alias("g"), S.regexp_split_to_array("p_type", "[ ]+").alias("parts"), S.regexp_substr(n, "[a-z]+", 1, 2).alias("second"))


@query("""SELECT o_orderkey, hex(o_orderkey::BIGINT) AS h0, lower(hex(o_orderkey)) AS h, bin(o_orderkey) AS b, md5(o_orderpriority) AS m, sha256(o_orderpriority) AS s, sha1(o_orderpriority) AS s1, to_base64(encode(o_orderpriority)) AS b64, lower(hex(encode(o_orderpriority))) AS hx FROM orders""")
def string_codes(t):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.hex(k).alias("h0"), S.to_hex(k).alias("h"), S.to_bin(k).alias("b"), M.md5(p).alias("m"), F.lower(F.hex(M.sha256(p))).alias("s"), F.lower(F.hex(M.sha1(p))).alias("s1"), M.encode(F.encode(p, "utf-8"), "base64").alias("b64"), M.encode(F.encode(p, "utf-8"), "hex").alias("hx"))


@query("""SELECT n_nationkey, '''' || replace(n_name, '''', '''''') || '''' AS lit, 'n=' || n_name || ' k=' || n_nationkey AS f, string_split(n_name, 'A') AS parts, upper(replace(n_name, ' ', '')[1]) || lower(replace(n_name, ' ', '')[2:]) AS cap FROM nation""")
def string_quotes(t):
    return t.nation.select("n_nationkey", S.quote_literal("n_name").alias("lit"), S.format("n=%s k=%s", "n_name", "n_nationkey").alias("f"), S.string_to_array("n_name", "A").alias("parts"), S.initcap(F.regexp_replace("n_name", " ", "")).alias("cap"))


@query("""SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS plain FROM documents""")
def string_to_ascii(t):
    return t.documents.select("doc_id", S.to_ascii("text").alias("plain"))


@query("""SELECT l_orderkey, l_linenumber, round(abs(l_discount - l_tax), 6) AS a, ceil(l_quantity / 7)::BIGINT AS c, floor(l_quantity / 7)::BIGINT AS f, round(sqrt(l_quantity), 6) AS s, round(cbrt(l_quantity), 6) AS cb, round(ln(l_quantity), 6) AS ln, round(log2(l_quantity), 6) AS l2, round(log10(l_quantity), 6) AS l10,
    round(exp(l_discount), 6) AS e, round(pow(l_quantity, 1.5), 4) AS p, sign(l_tax - 0.04)::INT AS sg, trunc(l_extendedprice / 100)::BIGINT AS tr, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le, (l_quantity::BIGINT % 7) AS m FROM lineitem""")
def math_basic(t):
    q, x, d, tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    r = F.round
    return t.lineitem.select("l_orderkey", "l_linenumber", r(F.abs(d - tax), 6).alias("a"), F.ceil(q / 7).alias("c"), F.floor(q / 7).alias("f"), r(F.sqrt(q), 6).alias("s"), r(F.cbrt(q), 6).alias("cb"), r(F.ln(q), 6).alias("ln"), r(F.log2(q), 6).alias("l2"), r(F.log10(q), 6).alias("l10"),
        r(F.exp(d), 6).alias("e"), r(F.pow(q, F.lit(1.5)), 4).alias("p"), N.sign(tax - 0.04).cast("int").alias("sg"), N.truncate(x / 100).alias("tr"), F.greatest(tax, d).alias("g"), F.least(tax, d).alias("le"), (q.cast("long") % 7).alias("m"))


@query("""SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(tan(l_discount), 6) AS t, round(asin(l_discount), 6) AS ai, round(acos(l_discount), 6) AS ac, round(atan(l_quantity), 6) AS at, round(atan2(l_quantity, l_extendedprice), 8) AS a2,
    round(sinh(l_discount), 6) AS sh, round(cosh(l_discount), 6) AS ch, round(tanh(l_discount), 6) AS th, round(degrees(l_tax), 6) AS dg, round(radians(l_quantity), 6) AS rd, round(cot(l_quantity), 5) AS ct FROM lineitem""")
def math_trigonometry(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    named = {"s": F.sin(q), "c": F.cos(q), "t": F.tan(d), "ai": F.asin(d), "ac": F.acos(d), "at": F.atan(q), "sh": F.sinh(d), "ch": F.cosh(d), "th": F.tanh(d), "dg": F.degrees("l_tax"), "rd": F.radians(q)}
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(k) for k, v in named.items()], F.round(F.atan2(q, F.col("l_extendedprice")), 8).alias("a2"), F.round(F.cot(q), 5).alias("ct"))


@query("""SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 10), 30) AS cl, round(round(l_extendedprice / 250) * 250, 2) AS qz, (CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END)::INT AS bk,
    round((l_quantity - 1) / 49, 6) AS mm, round(ln(l_extendedprice) / ln(7), 6) AS lg, (l_quantity::BIGINT // 7) AS dv, round(2 ** l_discount, 6) AS e2, l_quantity * l_quantity AS sq FROM lineitem""")
def math_ml(t):
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", N.clamp(q, 10.0, 30.0).alias("cl"), F.round(N.quantize(x, 250.0), 2).alias("qz"), N.bucketize(q, [10.0, 25.0, 40.0]).alias("bk"), F.round(N.min_max_normalize(q, 1.0, 50.0), 6).alias("mm"), F.round(N.log(x, 7), 6).alias("lg"),
        N.int_divide(q.cast("long"), F.lit(7)).alias("dv"), F.round(N.exp2("l_discount"), 6).alias("e2"), N.square(q).alias("sq"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, isodow(o_orderdate)::INT AS dow, dayofyear(o_orderdate)::INT AS doy, date_part('dow', o_orderdate)::DOUBLE AS dow0,
    epoch(o_orderdate)::DOUBLE AS ep, date_trunc('month', o_orderdate)::TIMESTAMP AS mon, date_trunc('quarter', o_orderdate)::TIMESTAMP AS qtr FROM orders""")
def temporal_parts(t):
    o = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(o).alias("y"), F.month(o).alias("m"), F.day(o).alias("d"), F.quarter(o).alias("q"), T.dayofweek(o).alias("dow"), F.dayofyear(o).alias("doy"), T.date_part("dow", o).alias("dow0"),
        T.date_part("epoch", o).alias("ep"), T.date_trunc("month", o).alias("mon"), T.date_trunc("quarter", o).alias("qtr"))


@query("""SELECT l_orderkey, l_linenumber, date_diff('year', l_shipdate, TIMESTAMP '1999-06-15 10:30:00')::FLOAT AS y, date_diff('month', l_shipdate, TIMESTAMP '1999-06-15 10:30:00')::FLOAT AS m, date_diff('day', l_shipdate, TIMESTAMP '1999-06-15 10:30:00')::FLOAT AS d,
    floor(date_diff('day', l_shipdate, TIMESTAMP '1999-06-15 10:30:00') / 7)::FLOAT AS w, date_add(l_shipdate, INTERVAL 3 MONTH) AS plus, time_bucket(INTERVAL 10 DAY, l_shipdate, TIMESTAMP '2001-01-01') AS bin FROM lineitem""")
def temporal_arithmetic(t):
    s, e = F.col("l_shipdate"), F.lit("1999-06-15 10:30:00").cast("timestamp_ntz")
    return t.lineitem.select("l_orderkey", "l_linenumber", *[T.date_diff(p, s, e).alias(p[0]) for p in ("year", "month", "day", "week")], T.date_add("month", F.lit(3), s).alias("plus"), T.date_bin(10 * T.DAY, s, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).alias("bin"))


@query("""SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 5) AS s, round(cos(2 * pi() * hour(ts) / 24), 5) AS c, make_timestamp(year(ts), month(ts), 1, hour(ts), 0, 0.0) AS made, make_date(year(ts), 1, 1) AS jan FROM events""")
def temporal_made(t):
    h, ts = F.hour("ts"), F.col("ts")
    pair = T.cyclical_encode(h, 24.0)
    return t.events.select("event_id", F.round(F.get(pair, F.lit(0)).cast("double"), 5).alias("s"), F.round(F.get(pair, F.lit(1)).cast("double"), 5).alias("c"), T.make_timestamp(F.year(ts), F.month(ts), F.lit(1), h, F.lit(0), F.lit(0.0)).alias("made"), F.make_date(F.year(ts), F.lit(1), F.lit(1)).alias("jan"))


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', l_shipdate, TIMESTAMP '1999-06-15')::INT AS days, 3 * date_diff('day', l_shipdate, TIMESTAMP '1999-06-15') // 90 AS quarters FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-06-15'""")
def temporal_intervals(t):
    s = F.col("l_shipdate")
    gap = F.datediff(F.lit("1999-06-15").cast("date"), s)
    j = T.justify_days(T.interval(0, gap, 0))
    back = (j["months"] * 30 + j["days"]).cast("int")
    return t.lineitem.where(s <= F.lit("1999-06-15 00:00:00").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", back.alias("days"), F.floor(3 * back / 90).cast("long").alias("quarters"))


@query("""SELECT vec_id, len(e)::INT AS n, round(list_sum(e), 4) AS s, round(list_avg(e), 5) AS a, round(list_max(e), 5) AS mx, round(list_min(e), 5) AS mn, round(e[2], 5) AS second, list_position(lab, label)::BIGINT AS pos, list_contains(lab, 3) AS has, array_to_string(lab, '|') AS joined, len(list_distinct(lab))::INT AS nd
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, [label, 3, label % 2, 3]::INT[] AS lab FROM embeddings)""")
def array_basic(t):
    e, lab = F.col("e"), F.col("lab")
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"), F.array(F.col("label"), F.lit(3), F.col("label") % 2, F.lit(3)).alias("lab"))
    return rows.select("vec_id", A.array_length(e).alias("n"), F.round(A.array_sum(e), 4).alias("s"), F.round(A.array_avg(e), 5).alias("a"), F.round(F.array_max(e), 5).alias("mx"), F.round(F.array_min(e), 5).alias("mn"), F.round(A.array_get(e, 2), 5).alias("second"),
        A.array_position(lab, F.col("label")).alias("pos"), F.array_contains(lab, 3).alias("has"), A.array_to_string(lab, "|").alias("joined"), F.size(F.array_distinct(lab)).alias("nd"))


@query("""SELECT vec_id, list_transform(l, lambda x: x * 2 + 1) AS tr, list_filter(l, lambda x: x % 2 = 0) AS fi, list_sort(l) AS so, list_reverse(l) AS re, l[2:3] AS sl, list_concat(l, [9]) AS co, list_reduce(l, lambda a, x: a + x) AS total FROM (SELECT vec_id, [label + 5, 3, label, 8]::INT[] AS l FROM embeddings)""")
def array_lambdas(t):
    x = F.col("l")
    rows = t.embeddings.select("vec_id", F.array(F.col("label") + 5, F.lit(3), F.col("label"), F.lit(8)).alias("l"))
    return rows.select("vec_id", A.array_transform(x, lambda v: v * 2 + 1).alias("tr"), A.array_filter(x, lambda v: v % 2 == 0).alias("fi"), A.array_sort(x).alias("so"), A.array_reverse(x).alias("re"), A.array_slice(x, 2, 2).alias("sl"), A.array_concat(x, F.array(F.lit(9)), "array<int>").alias("co"),
        F.aggregate(x, F.lit(0), lambda a, v: a + v).alias("total"))


@query("""SELECT event_id, props ->> '$.k' AS k0, json_valid(props) AS ok, len(json_keys(props))::INT AS n FROM events""")
def json_values(t):
    v = M.json_try_parse("props")
    return t.events.select("event_id", M.json_value(v, "$.k").alias("k0"), v.isNotNull().alias("ok"), F.size(F.json_object_keys("props")).alias("n"))


@query("""SELECT p_partkey, TRY_CAST(right(p_brand, 2) AS INT) AS n, TRY_CAST(p_name AS INT) AS bad, TRY_CAST(p_name AS INT) IS NOT NULL AS can, coalesce(nullif(p_size, 7), -1) AS c, p_size::DOUBLE AS d FROM part""")
def conversions(t):
    return t.part.select("p_partkey", M.try_cast(F.right("p_brand", F.lit(2)), "int").alias("n"), M.try_cast("p_name", "int").alias("bad"), M.can_cast("p_name", "int").alias("can"), F.coalesce(F.nullif(F.col("p_size"), F.lit(7)), F.lit(-1)).alias("c"), F.col("p_size").cast("double").alias("d"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS file, regexp_extract(url, '^(.*)/', 1) AS dir, regexp_extract(regexp_extract(url, '[^/]*$'), '(\\.[^.]*)$', 1) AS ext FROM pages""")
def paths(t):
    return t.pages.select("page_id", M.get_filename("url").alias("file"), M.get_directory("url").alias("dir"), M.get_filename_ext("url").alias("ext"))


@query("""SELECT c_custkey, 4::SMALLINT AS v, c_custkey % 97 AS b FROM customer""")
def uuids(t):
    u = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex("c_custkey")), 12, "0"))
    return t.customer.select("c_custkey", M.uuid_extract_version(u).alias("v"), (F.conv(F.right(u, F.lit(12)), 16, 10).cast("long") % 97).alias("b"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def assertions(t):
    p = M.assert_positive(M.assert_finite(M.assert_not_null("o_totalprice")))
    s = M.assert_in(M.assert_length("o_orderstatus", 1), ["F", "O", "P"])
    return t.orders.select("o_orderkey", F.when(s.isNotNull(), p).cast("double").alias("o_totalprice"))


@query()
def random_draws(t):
    """Draws of every distribution, the same at each run by their seeds."""
    return t.part.select("p_partkey", M.random(1, 6, seed=1).alias("die"), M.random_boolean(0.3, seed=2).alias("coin"), M.random_normal(0.0, 1.0, seed=3).alias("normal"), M.random_exponential(2.0, seed=4).alias("exponential"), M.random_log_normal(0.0, 0.5, seed=5).alias("log_normal"),
        M.random_categorical([0.2, 0.3, 0.5], seed=6).alias("class"), M.random_beta(2.0, 3.0, seed=7).alias("beta"), M.random_poisson(4.0, seed=8).alias("poisson"), M.random_truncated_normal(0.0, 1.0, -1.0, 1.0, seed=9).alias("truncated"))
