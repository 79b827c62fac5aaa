"""Column statistics, interactions of pairs, and the findings drawn from them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of the findings.
LIMITS = {"missing": 0.3, "critical": 0.8, "zeros": 0.5, "skew": 2.0, "kurtosis": 7.0, "outliers": 0.05, "one_hot": 20, "ordinal": 30, "near": 0.95, "identifier": 0.9}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame) -> dict[str, dict]:
    """One aggregation over all columns: counts, nulls, distinct, range, moments, quartiles, lengths."""
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = F.size(c) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(None).cast("int")
            own = {"nulls": F.sum(c.isNull().cast("long")), "min_size": F.min(size), "max_size": F.max(size)}
        else:
            own = {"nulls": F.sum(c.isNull().cast("long")), "distinct": F.approx_count_distinct(c), "min": F.min(c), "max": F.max(c)}
            if isinstance(f.dataType, T.NumericType):
                d = c.cast("double")
                own |= {"mean": F.avg(d), "stddev": F.stddev_samp(d), "skew": F.skewness(d), "kurtosis": F.kurtosis(d), "zeros": F.sum((d == 0).cast("long")), "quartiles": F.percentile_approx(d, [0.25, 0.5, 0.75], 10000)}
            if isinstance(f.dataType, T.StringType):
                own |= {"min_length": F.min(F.char_length(c)), "max_length": F.max(F.char_length(c)), "avg_length": F.avg(F.char_length(c))}
            if isinstance(f.dataType, T.BinaryType):
                own = {"nulls": own["nulls"], "min_size": F.min(F.octet_length(c)), "max_size": F.max(F.octet_length(c))}
        exprs += [v.alias(f"{f.name}\x00{k}") for k, v in own.items()]
    r = df.agg(*exprs).first().asDict()
    out: dict[str, dict] = {f.name: {"rows": r["__rows"], "type": f.dataType.simpleString()} for f in df.schema}
    for k, v in r.items():
        if "\x00" in k:
            name, stat = k.split("\x00")
            out[name][stat] = v
    return out


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) of equal widths between the smallest and the largest value."""
    c = F.col(column).cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    width = (high - low) / bins or 1.0
    return df.where(c.isNotNull()).groupBy(F.least(F.floor((c - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def missing_runs(df: DataFrame, column: str, order: str, partition: list[str]) -> DataFrame:
    """The longest run of nulls in order within each partition."""
    w = Window.partitionBy(*partition).orderBy(order)
    seen = df.withColumn("__g", F.sum(F.col(column).isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(column).isNull())
    return seen.groupBy(*partition, "__g").agg(F.count(F.lit(1)).alias("n")).groupBy(*partition).agg(F.max("n").alias("longest"))


def pearson(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    pairs = list(combinations(columns, 2))
    r = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else {}
    return {p: r[f"p{i}"] for i, p in enumerate(pairs)}


def missingness(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    marks = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    return pearson(marks, columns)


def spearman(df: DataFrame, a: str, b: str, sample: int = 10_000, seed: int = 0) -> float | None:
    """Correlation of ranks in a bounded sample."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).orderBy(F.rand(seed)).limit(sample).toPandas()
    return float(rows["a"].rank().corr(rows["b"].rank())) if len(rows) > 1 else None


def cramers_v(df: DataFrame, a: str, b: str, categories: int = 1000) -> float | None:
    """From joint counts; null if either has more than ``categories`` values."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if joint.agg(F.greatest(F.count_distinct("a"), F.count_distinct("b"))).first()[0] > categories:
        return None
    t = joint.toPandas()
    if not len(t):
        return None
    m = t.pivot(index="a", columns="b", values="n").fillna(0).to_numpy(float)
    e = m.sum(axis=1, keepdims=True) * m.sum(axis=0) / m.sum()
    k = min(m.shape) - 1
    return float(np.sqrt((((m - e) ** 2) / e).sum() / m.sum() / k)) if k else None


def anova_f(df: DataFrame, value: str, group: str) -> float | None:
    """The F statistic of group means, from counts, means and variances of the groups."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).where("n > 0")
    r = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("w")).first()
    if not r["k"] or r["k"] < 2 or r["n"] <= r["k"] or not r["w"]:
        return None
    between = r["q"] - r["s"] ** 2 / r["n"]
    return float(between / (r["k"] - 1) / (r["w"] / (r["n"] - r["k"])))


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 20) -> float:
    """Bits, from joint counts of values; numbers go to bins of equal width."""

    def cut(c: str):
        if c not in numeric_columns(df):
            return F.col(c).cast("string")
        low, high = df.agg(F.min(c), F.max(c)).first()
        width = ((high - low) / bins if low is not None else 1) or 1
        return F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1)).cast("string")

    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(cut(a).alias("a"), cut(b).alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    p = joint["n"] / joint["n"].sum()
    pa, pb = p.groupby(joint["a"]).transform("sum"), p.groupby(joint["b"]).transform("sum")
    return float((p * np.log2(p / (pa * pb))).sum())


def roles(stats: dict[str, dict]) -> dict[str, str]:
    """identifier, constant, category, measure, time, text or other for each column."""
    out = {}
    for name, s in stats.items():
        n, d = s["rows"] - (s.get("nulls") or 0), s.get("distinct")
        kind = s["type"]
        if not n or d == 1:
            out[name] = "constant"
        elif kind.startswith(("timestamp", "date")):
            out[name] = "time"
        elif d is not None and d >= LIMITS["identifier"] * n and (kind in ("bigint", "int", "string")):
            out[name] = "identifier" if (s.get("max_length") or 0) <= 64 else "text"
        elif d is not None and d <= LIMITS["ordinal"]:
            out[name] = "category"
        elif "mean" in s:
            out[name] = "measure"
        else:
            out[name] = "text" if kind == "string" else "other"
    return out


def insights(df: DataFrame, stats: dict[str, dict] | None = None) -> list[dict]:
    """Findings with the rule's name, the columns, how grave it is, and SQL that shows it."""
    stats = stats or profile(df)
    out = []

    def say(rule: str, columns: list[str], grave: str, value, sql: str) -> None:
        out.append({"rule": rule, "columns": columns, "severity": grave, "value": value, "sql": sql})

    for c, s in stats.items():
        n = s["rows"] or 1
        missing, present = (s.get("nulls") or 0) / n, n - (s.get("nulls") or 0)
        if missing >= LIMITS["missing"]:
            say("high_missingness", [c], "critical" if missing >= LIMITS["critical"] else "warning", missing, f"SELECT count(*) FROM t WHERE `{c}` IS NULL")
        if s.get("distinct") == 1 and present:
            say("constant_feature", [c], "warning", s["min"], f"SELECT DISTINCT `{c}` FROM t")
        if present and (s.get("zeros") or 0) / present >= LIMITS["zeros"]:
            say("zero_inflated", [c], "info", s["zeros"] / present, f"SELECT count(*) FROM t WHERE `{c}` = 0")
        if abs(s.get("skew") or 0) >= LIMITS["skew"]:
            say("skewness", [c], "info", s["skew"], f"SELECT skewness(`{c}`) FROM t")
        if (s.get("kurtosis") or 0) >= LIMITS["kurtosis"]:
            say("heavy_tailed", [c], "info", s["kurtosis"], f"SELECT kurtosis(`{c}`) FROM t")
        if s.get("quartiles"):
            a, _, b = s["quartiles"]
            low, high = a - 1.5 * (b - a), b + 1.5 * (b - a)
            far = df.where((F.col(f"`{c}`") < low) | (F.col(f"`{c}`") > high)).count() / max(present, 1)
            if far >= LIMITS["outliers"]:
                say("extreme_outliers", [c], "warning", far, f"SELECT count(*) FROM t WHERE `{c}` NOT BETWEEN {low} AND {high}")
            if s.get("mean") and s.get("stddev") and abs(s["max"] - s["min"]) > 1000:
                say("normalization", [c], "info", s["max"] - s["min"], f"SELECT min(`{c}`), max(`{c}`) FROM t")
        d = s.get("distinct")
        if s["type"] == "string" and d and 1 < d <= LIMITS["one_hot"]:
            say("categorical_encoding", [c], "info", d, f"SELECT `{c}`, count(*) FROM t GROUP BY 1")
        if s["type"] in ("int", "bigint") and d and 2 < d <= LIMITS["ordinal"]:
            say("possible_ordinal", [c], "info", d, f"SELECT `{c}`, count(*) FROM t GROUP BY 1 ORDER BY 1")
        if d and present and d >= LIMITS["identifier"] * present and s["type"] in ("int", "bigint", "string"):
            say("possible_identifier", [c], "info", d / present, f"SELECT count(DISTINCT `{c}`) FROM t")
    numbers = [c for c in numeric_columns(df) if stats[c].get("stddev")]
    for (a, b), r in pearson(df, numbers).items():
        if r is not None and abs(r) >= LIMITS["near"]:
            say("near_duplicate", [a, b], "warning", r, f"SELECT corr(`{a}`, `{b}`) FROM t")
    gaps = [c for c, s in stats.items() if 0 < (s.get("nulls") or 0) < s["rows"]]
    for (a, b), r in missingness(df, gaps).items():
        if r is not None and abs(r) >= 0.7:
            say("correlated_missingness", [a, b], "info", r, f"SELECT count(*) FROM t WHERE `{a}` IS NULL AND `{b}` IS NULL")
    return out
