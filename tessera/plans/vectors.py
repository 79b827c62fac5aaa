"""Vectors, activations, tokenizers, clustering and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import misc as M
from tessera.functions import vector as V
from tessera.operators import aggregates as A

from .base import query

_ONE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _with_first(t):
    """Every vector beside the one whose id is 0 (one row is broadcast)."""
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("q"))
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).join(F.broadcast(q), F.lit(True))


@query(f"""SELECT vec_id, round(list_inner_product(e, q), 5) AS dot, round(list_distance(e, q), 5) AS l2, round(list_cosine_similarity(e, q), 5) AS cos, round(list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2]))), 4) AS l1
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e, {_ONE} AS q FROM embeddings)""")
def vector_distances(t):
    r = F.round
    return _with_first(t).select("vec_id", r(V.dot_product("e", "q"), 5).alias("dot"), r(V.euclidean_distance("e", "q"), 5).alias("l2"), r(V.cosine_similarity("e", "q"), 5).alias("cos"), r(V.manhattan_distance("e", "q"), 4).alias("l1"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_ONE}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_ONE}) DESC, vec_id LIMIT 10")
def vector_topk(t):
    s = _with_first(t).select("vec_id", V.cosine_similarity("e", "q").alias("s")).orderBy(F.desc("s"), "vec_id").limit(10)
    return s.select("vec_id", F.round("s", 5).alias("score"))


@query("""SELECT vec_id, round(list_sum(e), 4) AS s, round(list_avg(e), 5) AS m, round(list_median(e), 5) AS md, round(list_var_pop(e), 5) AS v, round(sqrt(list_inner_product(e, e)), 5) AS n, (list_position(e, list_max(e)) - 1)::INT AS top, len(list_filter(e, lambda x: x > 0 OR x < 0))::INT AS nz
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def vector_statistics(t):
    e, r = F.col("e"), F.round
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", r(V.vec_sum(e), 4).alias("s"), r(V.vec_mean(e), 5).alias("m"), r(V.vec_median(e), 5).alias("md"), r(V.vec_var(e), 5).alias("v"), r(V.vec_norm(e), 5).alias("n"), (F.array_position(e, F.array_max(e)) - 1).cast("int").alias("top"), V.vec_count_nonzero(e).cast("int").alias("nz"))


@query("""SELECT vec_id, list_transform(e, lambda x: round(1 / (1 + exp(-x)), 5)) AS sg, list_transform(e, lambda x: round(greatest(x, 0.0), 5)) AS re, list_transform(e, lambda x: round(exp(x) / list_sum(list_transform(e, lambda y: exp(y))), 6)) AS sm
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def activations(t):
    e = F.col("embedding").cast("array<double>")
    short = lambda a, d=5: F.transform(a, lambda x: F.round(x, d))
    return t.embeddings.select("vec_id", short(V.sigmoid(e, array=True)).alias("sg"), short(V.relu(e, array=True)).alias("re"), short(V.softmax(e), 6).alias("sm"))


@query("""SELECT l_orderkey, l_linenumber, round(x / (1 + exp(-x)), 6) AS sw, round(ln(1 + exp(x)), 6) AS sp, round(x / (1 + abs(x)), 6) AS ss, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS el, round(CASE WHEN x > 0 THEN x ELSE 0.01 * x END, 6) AS lr, round(x * tanh(ln(1 + exp(x))), 6) AS mi,
    round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x ** 3))), 6) AS ge FROM (SELECT *, (l_quantity - 25) / 10 AS x FROM lineitem)""")
def activations_scalar(t):
    x = (F.col("l_quantity") - 25) / 10
    named = {"sw": V.swish, "sp": V.softplus, "ss": V.softsign, "el": V.elu, "lr": V.leaky_relu, "mi": V.mish, "ge": V.gelu}
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.round(f(x), 6).alias(k) for k, f in named.items()])


@query()
def kmeans(t):
    """Centroids and inertia for the vectors of each label."""
    return A.kmeans_fit(t.embeddings, ["label"], "embedding", 3)


@query("SELECT c_custkey, round(2 * 6371000.0 * asin(sqrt(sin(radians(c_nationkey) / 2) ** 2 + cos(radians(10.0)) * cos(radians(10.0 + c_nationkey)) * sin(radians(5.0) / 2) ** 2)), 2) AS metres FROM customer")
def haversine(t):
    return t.customer.select("c_custkey", F.round(M.haversine(F.lit(10.0), F.lit(20.0), F.lit(10.0) + F.col("c_nationkey"), F.lit(25.0)), 2).alias("metres"))


@query("SELECT vec_id, round(sqrt((e[1] - e[4]) ** 2 + (e[2] - e[5]) ** 2 + (e[3] - e[6]) ** 2), 5) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def points(t):
    e = lambda i: F.get("embedding", F.lit(i))
    return t.embeddings.select("vec_id", F.round(M.distance(M.point3d(e(0), e(1), e(2)), M.point3d(e(3), e(4), e(5))), 5).alias("d"))
