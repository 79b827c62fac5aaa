"""What keeps queries over large tables within their limits, on small ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import image as I
from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"


def tasks(spark, name: str) -> int:
    return registry.queries()[name](spark, FOLDER).rdd.getNumPartitions()


@pytest.mark.parametrize("name", ["image_changes", "image_measures", "image_files_and_tensors"])
def test_images_are_made_by_all_cores(spark, name):
    assert tasks(spark, name) >= spark.sparkContext.defaultParallelism


def test_equal_rows_are_worked_out_once(spark):
    rows = spark.createDataFrame([(i % 3 if i % 5 else None, [0.0, -0.0][i % 2], [float(i % 2), None]) for i in range(60)], "a int, b double, c array<double>").coalesce(1)
    seen = []

    def f(a, b, c):
        seen.append(1)
        return f"{a} {b!r} {c[0]} {np.isnan(c[1])} {len(seen)}"

    got = [r["x"] for r in rows.select(I._mapped("string", f, "a", "b", "c").alias("x")).collect()]
    for i, x in enumerate(got):
        assert x is None if i % 5 == 0 else x.split()[:4] == [str(i % 3), repr([0.0, -0.0][i % 2]), str(float(i % 2)), "True"]
    assert {int(x.split()[4]) for x in got if x} == set(range(1, 7))


def test_large_results_are_sent_in_parts(spark):
    rows = spark.range(0, 40, 1, 1)
    many = I._mapped("array<float>", lambda k: np.full(240_000, k), "id", size=960_000)
    got = rows.select("id", many.alias("v")).select("id", F.size("v").alias("n"), F.get("v", F.lit(9)).alias("x"))
    assert [(r["n"], r["x"]) for r in got.orderBy("id").collect()] == [(240_000, float(k)) for k in range(40)]
    assert "[parts(" in got._jdf.queryExecution().toString()
    assert "[parts(" in registry.queries()["waveforms"](spark, FOLDER)._jdf.queryExecution().toString()


def test_silent_frames_are_as_computed():
    v = np.random.default_rng(1).normal(size=1600) * 0.3
    out, wide = I.log_mel(v, 80), np.pad(np.pad(v, (0, 480_000 - 1600)), 200, mode="reflect")
    at = np.arange(3000)[:, None] * 160 + np.arange(400)
    power = np.abs(np.fft.rfft(wide[at] * np.hanning(401)[:-1], axis=1)) ** 2
    full = np.log10(np.maximum(I.mel_filters(80, 16_000, 400) @ power.T, 1e-10))
    assert np.allclose(out, (np.maximum(full, full.max() - 8) + 4) / 4, atol=1e-6) and I.log_mel(np.zeros(5), 80).shape == (80, 3000)


@pytest.mark.parametrize("name", ["random_ranges", "meshes"])
def test_rows_are_dealt_to_all_cores(spark, name):
    assert "REPARTITION_BY_NUM" in registry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()


def test_theta_join_makes_no_pairs(spark, tmp_path):
    nan, g = float("nan"), np.random.default_rng(3)
    value = lambda n: [None if x < -4 else nan if x > 4 else float(x) * 0.0 if x == 0 else float(x) for x in g.integers(-5, 6, n)]
    nation = lambda n: [None if k == 3 else int(k) for k in g.integers(0, 5, n)]
    c, s = list(zip(nation(300), value(300))), list(zip(range(40), nation(40), value(40)))
    s += [(7, 0, 1.0), (99, 0, nan)]
    spark.createDataFrame(c, "c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(s, "s_suppkey int, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    above = lambda x, y: x is not None and y is not None and y == y and (x != x or x > y)
    want: dict = {}
    for key, k, v in s:
        n = sum(k is not None and k == kc and above(vc, v) for kc, vc in c)
        want[key] = want.get(key, 0) + n
    df = registry.queries()["join_theta"](spark, str(tmp_path))
    assert {r["s_suppkey"]: r["richer"] for r in df.collect()} == {k: n for k, n in want.items() if n}
    assert "acctbal" not in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_license_base_does_without_the_join(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["license_base"](spark, FOLDER)
    want = __spark_entry__.queries()["op7_license_scan"](spark, FOLDER).select(df.columns)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.exceptAll(want).isEmpty() and want.exceptAll(df).isEmpty()


def test_depths_are_sorted_once_a_cloud(spark):
    from tessera.functions import mesh as G

    rows = spark.createDataFrame([([float(x) for x in range(21)],), ([5.0, 1.0, 9.0],), ([],), (None,)], "d array<double>")
    cloud = F.transform("d", lambda z: F.struct(z.alias("x"), z.alias("y"), z.alias("z")))
    df = rows.select("d", F.transform(G.pc_filter_depth_percentile(cloud, 0.05, 0.95), lambda p: p["z"]).alias("kept"))
    for r in df.collect():
        assert r["kept"] == (None if r["d"] is None else [z for z in r["d"] if np.quantile(r["d"], 0.05) <= z <= np.quantile(r["d"], 0.95)])
    assert df._jdf.queryExecution().analyzed().toString().count("array_sort") == 1
