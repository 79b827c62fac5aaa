"""More of the function library over whole tables: one query for each family of functions, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import array as L
from tessera.functions import math as N
from tessera.functions import misc as M
from tessera.functions import string as S
from tessera.functions import temporal as D
from tessera.functions import vector as V

from .base import dealt, query


def _near(x, digits: int = 5):
    """Rounded; what is below zero keeps its sign where it is rounded to zero, as in SQL."""
    x = x.cast("double")
    return F.when(x < 0, -F.abs(F.round(x, digits))).otherwise(F.round(x, digits) + 0.0)


def _short(a, digits: int = 5):
    return F.transform(a, lambda x: _near(x, digits))


@query("""SELECT n_nationkey, lower(n_name) AS folded, chr(65 + n_nationkey::INT) AS ch, contains(n_name, 'AN') AS has, n_name[1:2] || '**' || n_name[4:] AS over, CASE WHEN regexp_full_match(n_name, '[a-z_][a-z0-9_]*') THEN n_name ELSE '"' || n_name || '"' END AS ident,
    coalesce('''' || nullif(n_name, 'CHINA') || '''', 'NULL') AS nullable, nfc_normalize(n_name || 'e' || chr(769)) AS nfc FROM nation""")
def string_codepoints(t):
    n = F.col("n_name")
    return t.nation.select("n_nationkey", S.casefold(n).alias("folded"), S.chr_(65 + F.col("n_nationkey")).alias("ch"), F.contains(n, F.lit("AN")).alias("has"), F.overlay(n, F.lit("**"), 3, 1).alias("over"), S.quote_ident(n).alias("ident"),
        S.quote_nullable(F.nullif(n, F.lit("CHINA"))).alias("nullable"), S.normalize(F.concat(n, F.lit("é"))).alias("nfc"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^[^aeiou]*')) + 1 ELSE 0 END AS at, CASE WHEN regexp_matches(p_name, '(\\w+) (\\w+)') THEN [regexp_extract(p_name, '(\\w+) (\\w+)', 1), regexp_extract(p_name, '(\\w+) (\\w+)', 2)] END AS pair,
    printf('%o', p_size::INT) AS oct, chr(233) || 'a' AS uni, ['a b', lower('C')] AS ident, p_name AS query FROM part""")
def string_patterns(t):
    p = F.col("p_name")
    return t.part.select("p_partkey", S.regexp_instr(p, "[aeiou]").alias("at"), S.regexp_match(p, r"(\w+) (\w+)").alias("pair"), S.to_oct("p_size").alias("oct"), S.unistr(F.lit("\\00e9a")).alias("uni"), S.parse_ident(F.lit('"a b".C')).alias("ident"), S.plainto_tsquery(p).alias("query"))


@query("""SELECT o_orderkey, isfinite(o_totalprice) AS fin, isinf(o_totalprice / 0) AS inf, isnan('nan'::DOUBLE) AS nan, round(o_totalprice * 3 + 2, 2) AS den, -o_totalprice AS neg, round(pi(), 10) AS p FROM orders""")
def math_predicates(t):
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", N.is_finite(x).alias("fin"), N.is_infinite(F.when(x.isNotNull(), F.lit(float("inf")))).alias("inf"), N.is_nan(F.lit(float("nan"))).alias("nan"), F.round(N.denormalize(x, 2.0, 5.0), 2).alias("den"), N.negate(x).alias("neg"), F.round(F.pi(), 10).alias("p"))


@query("""SELECT o_orderkey, length(o_orderstatus) AS n, o_orderstatus AS a, o_orderstatus AS b, o_orderpriority AS c, o_orderpriority AS d, o_orderstatus AS e, o_totalprice::DOUBLE AS f, o_totalprice::DOUBLE AS g, o_totalprice::DOUBLE AS h, true AS i, false AS j FROM orders""")
def assertions_all(t):
    """Every assertion that holds for all rows passes its value on."""
    s, p, x = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice").cast("double")
    ends = M.assert_ends_with(M.assert_starts_with(p, F.substring(p, 1, 1)), F.substring(p, -1, 1))
    return t.orders.select(
        "o_orderkey", F.char_length(M.assert_length(s, 1)).alias("n"), M.assert_not_in(M.assert_in(s, ["O", "F", "P"]), ["Q"]).alias("a"), M.assert_not_equal(M.assert_equal(s, s), F.lit("")).alias("b"), ends.alias("c"), M.assert_matches(M.assert_non_empty(p), r"^\d-").alias("d"),
        M.assert_not_null(s).alias("e"), M.assert_between(M.assert_greater_or_equal(M.assert_greater_than(x, -1.0), 0.0), 0.0, 1e9).cast("double").alias("f"), M.assert_less_or_equal(M.assert_less_than(x, 1e9), 1e9).cast("double").alias("g"), M.assert_positive(M.assert_non_negative(x)).cast("double").alias("h"),
        M.assert_true(x > 0).cast("boolean").alias("i"), M.assert_false(x < 0).cast("boolean").alias("j"),
    )


@query("""SELECT event_id, date_diff('second', TIMESTAMP '2020-01-01', ts) > 0 AS past, minute(ts) AS mi, (hour(ts) * 3600 + minute(ts) * 60)::BIGINT * 1000000 AS tm, ((86400 - hour(ts) * 3600) % 86400)::BIGINT * 1000000 AS td, round(hour(ts) / 24.0, 4) AS dd, hour(ts)::DOUBLE AS dh, hour(ts) * 60.0 AS dm, hour(ts) * 3600.0 AS ds,
    14 AS ym, 2 AS jd, 3600000000 AS jm, 1 AS im, 5 AS iday, 93784000000::BIGINT AS du FROM events""")
def temporal_durations(t):
    h = D.hour("ts")
    hours = D.make_duration(F.lit(0), h, F.lit(0), F.lit(0))
    turned, all_of = D.justify_hours(D.make_interval(hours=49)), D.justify_interval(D.make_interval(days=34, hours=24))
    return t.events.select(
        "event_id", (D.micros("ts") > D.micros(F.lit("2020-01-01").cast("timestamp"))).alias("past"), D.minute("ts").alias("mi"), D.make_time(h, D.minute("ts"), F.lit(0)).alias("tm"), D.time_diff(hours, F.lit(0)).alias("td"), F.round(D.duration_days(hours), 4).alias("dd"), D.duration_hours(hours).cast("double").alias("dh"),
        D.duration_minutes(hours).cast("double").alias("dm"), D.duration_seconds(hours).cast("double").alias("ds"), D.interval_qualified("1-2", "YEAR TO MONTH")["months"].alias("ym"), turned["days"].alias("jd"), turned["micros"].alias("jm"), all_of["months"].alias("im"), all_of["days"].alias("iday"),
        D.make_duration(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("du"),
    )


@query("""SELECT event_id, date_sub('month', b, ts) AS months, CAST(floor(date_diff('microsecond', b + to_months(date_sub('month', b, ts)::INT), ts) / 86400000000) AS INT) AS days FROM (SELECT event_id, ts, TIMESTAMP '2019-01-15 00:00:00' AS b FROM events)""")
def temporal_age(t):
    a = D.age("ts", F.lit("2019-01-15 00:00:00").cast("timestamp_ntz"))
    return t.events.select("event_id", a["months"].alias("months"), a["days"].alias("days"))


@query("""SELECT vec_id, len(e) AS n, list_transform(e || e, lambda x: round(x, 5)) AS fl, len(e) AS card, [7.0, 7.0, 7.0] AS rep, [len(e)] AS shape, 1 AS nd, true AS sh, true AS rc, round((e[1] + e[2] + e[3] + e[4]) / 4, 5) AS r2 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def array_shapes(t):
    e = F.col("e")
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    small = L.array_resize_2d(F.slice(e, 1, 4), (2, 2), (1, 1))
    return rows.select("vec_id", F.size(e).alias("n"), _short(F.flatten(F.array(e, e))).alias("fl"), F.cardinality(e).alias("card"), F.array_repeat(F.lit(7.0), 3).alias("rep"), L.array_shape(e).alias("shape"), L.array_ndims(e).alias("nd"),
        (F.array_sort(F.shuffle(e)) == F.array_sort(e)).alias("sh"), F.array_contains(e, L.random_choice(e, 3)).alias("rc"), _near(F.get(small, F.lit(0))).alias("r2"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS norm1, list_transform(e, lambda x: round(x / n, 5)) AS l2, (list_position(e, list_max(e)) - 1)::INT AS amax, (list_position(e, list_min(e)) - 1)::INT AS amin, round(list_min(e), 5) AS mi, round(list_max(e), 5) AS ma, round(list_stddev_pop(e), 5) AS sd,
    list_transform(list_reverse(e), lambda x: round(x, 5)) AS rev, list_transform(list_sort(e), lambda x: round(x, 5)) AS srt, len(list_distinct(e))::INT AS uni, list_transform(e || [0.0, 0.0], lambda x: round(x, 5)) AS pad, list_transform(e || e, lambda x: round(x, 5)) AS rep, true AS any, NOT list_contains(e, 0.0) AS all_, round(list_product(e[1:4]), 8) AS prod
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)""")
def vector_shapes(t):
    e = F.col("e")
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(V.vec_norm(e), 5).alias("norm1"), _short(V.l2_normalize(e)).alias("l2"), V.argmax(e).alias("amax"), V.argmin(e).alias("amin"), F.round(V.vec_min(e), 5).alias("mi"), F.round(V.vec_max(e), 5).alias("ma"), F.round(V.vec_std(e), 5).alias("sd"),
        _short(V.vec_reverse(e)).alias("rev"), _short(V.vec_sort(e)).alias("srt"), F.size(V.vec_unique(e)).alias("uni"), _short(V.vec_pad(F.concat(e, F.array(F.lit(0.0))), 2 + 64)).alias("pad"), _short(V.vec_repeat(e, 2)).alias("rep"), V.vec_any(e).alias("any"), V.vec_all(e).alias("all_"), _near(V.vec_product(F.slice(e, 1, 4)), 8).alias("prod"))


@query("""SELECT vec_id, [0.0, 0.5, 1.0] AS lin, [0.0, 2.0, 4.0] AS ara, [1.0, 2.5] AS v, CASE WHEN e[1] < 0 THEN 0 ELSE 1 END AS near, list_transform(e[1:3], lambda x: round(x - 0.5, 5)) AS pr, list_transform(range(1, len(e) + 1), lambda i: round(e[i] + 2 * e[len(e) + 1 - i], 5)) AS axpy, list_transform(e, lambda x: round(3 * x, 5)) AS scl,
    list_transform(e, lambda x: round(least(greatest(x, -0.05), 0.05), 5)) AS clm, list_transform([e[1], e[2], e[1], e[3], e[4], e[2]], lambda x: round(x, 5)) AS cat, list_transform([e[3], e[4]], lambda x: round(x, 5)) AS pool, (CASE WHEN (e[1] > 0) = (e[2] > 0) THEN 0 ELSE 1 END)::DOUBLE AS ham
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def vector_arithmetic(t):
    e = F.col("e")
    at = lambda i: F.get(e, F.lit(i))
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    unit = [[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)]
    sign = lambda i: F.when(at(i) > 0, "a").otherwise("b")
    return rows.select(
        "vec_id", V.linspace(0, 1, 3).alias("lin"), V.arange(0, 6, 2).alias("ara"), _short(V.vec(1.0, 2.5)).alias("v"), V.nearest_centroid([[-1.0], [1.0]], F.slice(e, 1, 1)).alias("near"), _short(V.pca_project([0.5] * 3, unit, F.slice(e, 1, 3))).alias("pr"), _short(V.array_axpy(e, 2.0, F.reverse(e))).alias("axpy"),
        _short(V.array_scale(e, 3.0)).alias("scl"), _short(V.array_clamp(e, -0.05, 0.05)).alias("clm"), _short(V.array_concat_last_dim(F.array(at(0), at(1), at(2), at(3)), 2, F.array(at(0), at(1)), 1)).alias("cat0"), _short(V.mean_pool_masked(F.slice(e, 1, 4), F.array(F.lit(0.0), F.lit(1.0)), 2)).alias("pool"),
        V.hamming_distance(sign(0), sign(1)).alias("ham"),
    ).withColumn("cat", F.col("cat0")).drop("cat0")


@query("""SELECT l_orderkey, l_linenumber, round(1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END, 6) AS se, round(least(greatest(x / 6 + 0.5, 0), 1), 6) AS hs, round(x * least(greatest(x / 6 + 0.5, 0), 1), 6) AS hw, [round(x - ln(exp(x) + 1), 6), round(-ln(exp(x) + 1), 6)] AS ls,
    CASE WHEN x >= 0 THEN ['p'] ELSE [] END AS ml FROM (SELECT *, (l_quantity - 25) / 10 AS x FROM lineitem)""")
def activations_more(t):
    x = (F.col("l_quantity") - 25) / 10
    pair = F.array(x.cast("double"), F.lit(0.0))
    labels = F.transform(V.multilabel_classify(F.array(x.cast("double"), F.lit(-9.0)), ["p", "q"]), lambda z: z["label"])
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(V.selu(x), 6).alias("se"), F.round(V.hard_sigmoid(x), 6).alias("hs"), F.round(V.hard_swish(x), 6).alias("hw"), _short(V.log_softmax(pair), 6).alias("ls"), labels.alias("ml"))


@query("""SELECT o_orderkey, '{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '","a":[1,2]}' AS js, '[1,2]' AS arr, o_orderkey AS k, NULL::VARCHAR AS scalar FROM orders""")
def json_documents(t):
    text = F.concat(F.lit('{"k":'), F.col("o_orderkey").cast("string"), F.lit(',"s":"'), F.col("o_orderstatus"), F.lit('","a":[1,2]}'))
    doc = M.json_parse(text)
    keys = F.from_json(M.json_to_text(doc), "k long, s string, a array<int>")
    return t.orders.select("o_orderkey", F.to_json(keys).alias("js"), M.json_to_text(M.json_query(doc, "$.a")).alias("arr"), M.json_value(doc, "$.k", "long").alias("k"), M.json_to_text(M.json_query(doc, "$.k")).alias("scalar"))


@query("""SELECT c_custkey, md5(c_name) AS d1, sha256(c_name) AS d2, c_name AS back, 7 AS v7, 4 AS v4, true AS fresh, '00000000-0000-4000-8000-000000000000' AS u, 'BIGINT' AS ty FROM customer""")
def digests_and_ids(t):
    n = F.col("c_name")
    seven = M.uuidv7()
    return t.customer.select("c_custkey", F.lower(F.hex(M.digest(n, "md5"))).alias("d1"), F.lower(F.hex(M.digest(n, "sha256"))).alias("d2"), M.decode(M.encode(F.encode(n, "utf-8"), "base64"), "base64").cast("string").alias("back"), M.uuid_extract_version(seven).cast("int").alias("v7"),
        M.uuid_extract_version(M.uuidv4()).cast("int").alias("v4"), (M.uuid_extract_timestamp(seven) > F.lit("2020-01-01").cast("timestamp")).alias("fresh"), M.uuid_str(F.lit("00000000-0000-4000-8000-000000000000")).alias("u"), F.upper(F.typeof("c_custkey")).alias("ty"))


@query("""SELECT 'data/x.' || n_nationkey || '.bin' AS p1, 'x.' || n_nationkey AS p2, 'data/sub/f.txt' AS p3 FROM nation""")
def paths_changed(t):
    path = F.concat(F.lit("data/x."), F.col("n_nationkey").cast("string"), F.lit(".csv"))
    return t.nation.select(M.change_filename_ext(path, ".bin").alias("p1"), M.get_filename_no_ext(path).alias("p2"), M.path_concat(F.lit("data/"), F.lit("sub"), F.lit("f.txt")).alias("p3"))


@query("""SELECT l_orderkey, l_linenumber, round(2 + 3 * t, 6) AS le, round(2 + 3 * (0.5 + 0.5 * sin(2 * pi() * t)), 6) AS os, round(least(greatest(t / 0.5, 0), 1), 6) AS fi, round(least(greatest((1 - t) / 0.5, 0), 1), 6) AS fo, round(2 + 3 * (1 - abs(cos(pi() * 2 * t)) * (1 - t)), 6) AS bo, round(CASE WHEN t < 1 / 2.75 THEN 7.5625 * t ** 2 WHEN t < 2 / 2.75 THEN 7.5625 * (t - 1.5 / 2.75) ** 2 + 0.75 WHEN t < 2.5 / 2.75 THEN 7.5625 * (t - 2.25 / 2.75) ** 2 + 0.9375 ELSE 7.5625 * (t - 2.625 / 2.75) ** 2 + 0.984375 END, 6) AS b3, true AS wo, true AS rw FROM (SELECT *, l_quantity / 50 AS t FROM lineitem)""")
def easing(t):
    x = F.col("l_quantity") / 50
    r = lambda c: F.round(c, 6)
    return t.lineitem.select("l_orderkey", "l_linenumber", r(M.lerp(x, 2.0, 5.0)).alias("le"), r(M.oscillate(x, 2.0, 5.0)).alias("os"), r(M.fade_in(x, 0.5)).alias("fi"), r(M.fade_out(x, 0.5)).alias("fo"), r(M.bounce(x, 2.0, 5.0, 2)).alias("bo"), r(M.bounce(x, 0.0, 1.0)).alias("b3"), M.wobble(x, 2.0, 5.0, 3).between(2.0, 5.0).alias("wo"), M.random_walk(x, 2.0, 5.0, 8, 3).between(2.0, 5.0).alias("rw"))


@query("""SELECT vec_id, round((e[1] - e[3]) ** 2 + (e[2] - e[4]) ** 2, 5) AS d2, round(e[1], 5) AS px, round(e[2], 5) AS py, round(e[3], 5) AS pz, list_transform([e[1] + 1, e[2] + 2, e[3] + 3], lambda x: round(x, 5)) AS moved, 2 AS n, round(least(e[1], e[4]), 5) AS lo, round(greatest(e[3], e[6]), 5) AS hi, round(-e[1], 5) AS inv,
    ((e[3] BETWEEN 0 AND 9)::INT + (e[6] BETWEEN 0 AND 9)::INT)::INT AS deep, 4 AS fused, round(e[1], 5) AS world FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def point_clouds(t):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    r = lambda c: F.round(c, 5)
    p, q = M.point3d(at(0), at(1), at(2)), M.point3d(at(3), at(4), at(5))
    cloud = F.array(p, q)
    pose = M.pose_compose(M.pose_translate(F.lit(1.0), F.lit(2.0), F.lit(3.0)), M.pose_identity())
    first = F.get(M.pc_transform(cloud, pose), F.lit(0))
    there = M.pose_translate(at(0), at(1), at(2))
    return t.embeddings.select(
        "vec_id", r(M.distance_sq(M.point2d(at(0), at(1)), M.point2d(at(2), at(3)), 2)).alias("d2"), r(M.point_x(p)).alias("px"), r(M.point_y(p)).alias("py"), r(M.point_z(p)).alias("pz"), _short(F.array(first["x"], first["y"], first["z"])).alias("moved"), M.point_cloud_count(cloud).alias("n"),
        r(M.point_cloud_bbox_min(cloud)["x"]).alias("lo"), r(M.point_cloud_bbox_max(cloud)["z"]).alias("hi"), (r(F.get(M.pose_inverse(there), F.lit(3))) + 0.0).alias("inv"), F.size(M.pc_filter_depth(cloud, 0.0, 9.0)).alias("deep"), F.size(M.pc_fuse(cloud, cloud)).alias("fused"), r(M.pose_to_world_position(there)["x"]).alias("world"),
    )


@query("""SELECT count(*) AS n, true AS r1, true AS r2, true AS r3, true AS r4, true AS r5, true AS r6, true AS r7, true AS r8, true AS r9, true AS r10 FROM orders""")
def random_ranges(t):
    """Every draw lies in its range, and means lie where they should."""
    drawn = dealt(t.orders.select("o_orderkey")).select(
        M.random(1, 6, 1).alias("a"), M.random_boolean(0.5, 2).alias("b"), M.random_exponential(2.0, 3).alias("c"), M.random_normal(1.0, 0.5, 4).alias("d"), M.random_log_normal(0.0, 0.5, 5).alias("e"), M.random_categorical([1.0, 1.0, 2.0], 6).alias("f"), M.random_beta(2.0, 2.0, 7).alias("g"), M.random_poisson(3.0, 8).alias("h"),
        M.random_truncated_normal(0.0, 1.0, -1.0, 1.0, 9).alias("i"), F.size(M.random_vector(4, 10)).alias("j"), F.size(M.random_normal_vector(3, 0.0, 1.0, 11)).alias("k"),
    )
    near = lambda c, m, d: F.abs(F.avg(c.cast("double")) - m) < d
    c = F.col
    return drawn.agg(
        F.count(F.lit(1)).alias("n"), ((F.min("a") >= 1) & (F.max("a") <= 6) & near(c("a"), 3.5, 0.3)).alias("r1"), near(F.when(c("b"), 1).otherwise(0), 0.5, 0.1).alias("r2"), ((F.min("c") >= 0) & near(c("c"), 0.5, 0.1)).alias("r3"), near(c("d"), 1.0, 0.1).alias("r4"), (F.min("e") > 0).alias("r5"),
        ((F.min("f") == 0) & (F.max("f") == 2)).alias("r6"), near(c("g"), 0.5, 0.1).alias("r7"), near(c("h"), 3.0, 0.4).alias("r8"), ((F.min("i") >= -1) & (F.max("i") <= 1)).alias("r9"), ((F.min("j") == 4) & (F.max("k") == 3)).alias("r10"),
    )


@query("""SELECT o_orderkey, hash_ok FROM (SELECT o_orderkey, true AS hash_ok FROM orders)""")
def hash_splits(t):
    """Fractions of a key by two seeds lie in [0, 1), and numbers are hashed by the bytes of their type."""
    k = F.col("o_orderkey")
    a, b = M.hash_split(k), M.hash_split(k, 9)
    return t.orders.select("o_orderkey", ((a >= 0) & (a < 1) & (b >= 0) & (b < 1)).alias("hash_ok"))


@query("""SELECT n_nationkey, [n_nationkey, 255, 0, 255]::INT[] AS c1, [255, 170, 0, 128]::INT[] AS c2, [17, 34, 51, 255]::INT[] AS c3, [round(n_nationkey / 2), 127, 20, 255]::INT[] AS c4, [90.0, 0.0, 0.0] AS e FROM nation""")
def colors_and_poses(t):
    flat = lambda c: F.array(*[c[k] for k in "rgba"])
    k = F.col("n_nationkey")
    mixed = M.color_interpolate(M.color(k, F.lit(254), F.lit(40)), M.color(F.lit(0), F.lit(0), F.lit(0)), F.lit(0.5))
    turned = F.array(*[F.lit(float(v)) for v in (0, 0, 1, 0, 0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 0, 1)])
    return t.nation.select("n_nationkey", flat(M.color(k, F.lit(300), F.lit(-4))).alias("c1"), flat(M.color_hex(F.lit("#ffaa0080"))).alias("c2"), flat(M.color_hex(F.lit("123"))).alias("c3"), flat(mixed).alias("c4"), _short(M.pose_to_euler_degrees(turned)).alias("e"))
