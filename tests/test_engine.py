"""The dialect, tables that change, sources of special formats and folds, on small inputs."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import dialect, tables
from tessera.functions import misc, string, temporal
from tessera.operators import relational as R
from tessera.sources import readers


def test_rewriting():
    assert dialect.rewrite("SELECT a ^ 2 FROM t ORDER BY a DESC, b").replace(" ,", ",") == "SELECT pow(a, 2) FROM t ORDER BY a DESC NULLS FIRST, b NULLS LAST"
    text = dialect.rewrite("SELECT sum(x) OVER (PARTITION BY g ORDER BY y) AS s, rank() OVER (ORDER BY y) AS r FROM t")
    assert text.count("UNBOUNDED FOLLOWING") == 1 and text.count("NULLS LAST") == 2
    assert "TABLESAMPLE (10 PERCENT) REPEATABLE (7)" in dialect.rewrite("SELECT * FROM t TABLESAMPLE BERNOULLI(10) REPEATABLE(7)")
    assert "ORDER BY" not in dialect.rewrite("SELECT ';ORDER BY' AS x").replace("';ORDER BY'", "")


def test_clauses(spark):
    rows = spark.createDataFrame([(1, "a", 10.0), (2, "a", None), (3, "b", 5.0)], "id int, g string, x double")
    run = lambda q: [tuple(r) for r in dialect.sql(spark, q, t=rows).collect()]
    assert run("SELECT id FROM {t} ORDER BY x") == [(3,), (1,), (2,)]
    assert run("SELECT id FROM {t} ORDER BY x DESC") == [(2,), (1,), (3,)]
    assert run("SELECT LET y = x * 2, id, y + 1 AS z FROM {t} WHERE y > 15") == [(1, 21.0)]
    assert run("SELECT id, g FROM {t} QUALIFY row_number() OVER (PARTITION BY g ORDER BY id DESC) = 1 ORDER BY id") == [(2, "a"), (3, "b")]
    assert run("SELECT id, ASSERT x > 7 ON FAIL SKIP FROM {t}") == [(1,)]
    assert len(run("SELECT * FROM {t} TABLESAMPLE BALANCED(1) ON (g) REPEATABLE(3)")) == 2
    folds = run("SELECT id FROM {t} CROSS VALIDATE(3, 42) ON id AS fold")
    assert all(0 <= f < 3 for _, f in folds) and len(folds) == 3
    assert run("SELECT g, count(*) AS n FROM {t} GROUP BY g HAVING count(*) > 1") == [("a", 2)]
    assert run("WITH q AS (SELECT id FROM {t} QUALIFY rank() OVER (ORDER BY id) = 1) SELECT id FROM q UNION ALL SELECT 9") == [(1,), (9,)]
    assert run("SELECT id FROM {t} WHERE concat('Big ', g, id) @@ 'the BIG b3'") == [(3,)]
    with pytest.raises(Exception, match="too small"):
        run("SELECT id, ASSERT x > 7 MESSAGE 'too small' FROM {t}")


def test_table(spark, tmp_path):
    rules = tables.Rules(primary_key=["id"], default={"state": "'new'"}, computed={"twice": "x * 2"}, identity="id")
    first = spark.createDataFrame([(None, 1.0, None, None), (None, 2.0, None, None)], "id long, x double, state string, twice double")
    t = tables.Table.create(spark, f"file://{tmp_path}/t", first, rules)
    assert sorted(r["id"] for r in t.read().collect()) == [1, 2]
    got = t.insert(spark.createDataFrame([(5.0,), (6.0,)], "x double"))
    assert sorted((r["id"], r["state"], r["twice"]) for r in got.collect()) == [(3, "new", 10.0), (4, "new", 12.0)]
    assert [r["twice"] for r in t.update("id = 1", x="7D").collect()] == [14.0]
    assert [r["id"] for r in t.delete("x = 2").collect()] == [2]
    t.update_from(spark.createDataFrame([(3, 50.0), (3, 60.0)], "id long, y double"), "id", x="y")
    assert {r["id"]: r["x"] for r in t.read().collect()} == {1: 7.0, 3: 60.0, 4: 6.0}
    before = t.version
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(1, 0.0)], "id long, x double"))
    assert t.version == before and t.read().count() == 3
    t.add_column("z", "int", default="4")
    assert {r["z"] for r in t.read().collect()} == {4}
    t.drop_column("z")
    assert "z" not in t.read().columns


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("two.bin", "22")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("three.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"333"))
    rows = readers.open_archive(spark, str(tmp_path)).select("entry", "size").collect()
    assert sorted(tuple(r) for r in rows) == [("three.txt", 3), ("two.bin", 2), ("x/one.txt", 1)]
    assert readers.open_archive(spark, str(tmp_path), "*.txt").count() == 2
    assert readers.list_folder(spark, str(tmp_path), pattern="*.zip").first()["file_name"] == "a.zip"


def test_idx_and_cifar(spark, tmp_path):
    images = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "i.idx").write_bytes(struct.pack(">HBBIII", 0, 8, 3, 2, 3, 4) + images.tobytes())
    (tmp_path / "l.idx").write_bytes(struct.pack(">HBBI", 0, 8, 1, 2) + bytes([7, 9]))
    rows = readers.open_idx_images(spark, str(tmp_path / "i.idx")).orderBy("index").collect()
    assert [(r["height"], r["width"], bytes(r["pixels"])) for r in rows] == [(3, 4, x.tobytes()) for x in images]
    assert [r["label"] for r in readers.open_idx_labels(spark, str(tmp_path / "l.idx")).orderBy("index").collect()] == [7, 9]
    record = bytes([3]) + bytes(1024) + bytes([1] * 1024) + bytes([2] * 1024)
    frame = spark.createDataFrame([(bytearray(record * 2),)], "bytes binary")
    rows = readers.open_cifar10(frame).collect()
    assert [r["label"] for r in rows] == [3, 3] and bytes(rows[0]["pixels"][:3]) == bytes([0, 1, 2])


def _card(k: str, v: str) -> str:
    return f"{k:<8}= {v:>20}".ljust(80)


def test_fits(spark, tmp_path):
    def unit(cards, data):
        head = ("".join(cards) + "END".ljust(80)).encode()
        return head.ljust(-(-len(head) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")

    image = unit([_card("SIMPLE", "T"), _card("BITPIX", "16"), _card("NAXIS", "2"), _card("NAXIS1", "3"), _card("NAXIS2", "2")], np.arange(6, dtype=">i2").tobytes())
    table = np.array([(1, 2.5), (3, 4.5)], [("a", ">i4"), ("b", ">f8")])
    binary = unit([_card("XTENSION", "'BINTABLE'"), _card("BITPIX", "8"), _card("NAXIS", "2"), _card("NAXIS1", "12"), _card("NAXIS2", "2"), _card("PCOUNT", "0"), _card("GCOUNT", "1"), _card("TFIELDS", "2"),
        _card("TTYPE1", "'a'"), _card("TFORM1", "'J'"), _card("TTYPE2", "'b'"), _card("TFORM2", "'1D'"), _card("EXTNAME", "'rows'")], table.tobytes())
    (tmp_path / "f.fits").write_bytes(image + binary)
    at = str(tmp_path / "f.fits")
    assert [(r["hdu_index"], r["kind"]) for r in readers.open_fits_hdus(spark, at).orderBy("hdu_index").collect()] == [(0, "image"), (1, "bintable")]
    got = readers.open_fits_images(spark, at).collect()
    assert [r["data"] for r in got] == [[0.0, 1.0, 2.0, 3.0, 4.0, 5.0]] and got[0]["shape"] == [2, 3]
    assert [tuple(r) for r in readers.open_fits_table(spark, at, "rows").collect()] == [(1, 2.5), (3, 4.5)]


def test_csv_is_sniffed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;size\nx;1\ny;2\n")
    rows = readers.open_csv_typed(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["name", "size"] and sorted(r["size"] for r in rows.collect()) == [1, 2]


def test_fold_sees_the_previous_row(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, None), ("b", 2, 4), (None, 1, 3)], "k string, t int, v int")
    out = R.scan(rows, ["k"], ["t"], lambda r: 100, lambda s, r, p: s + (r["v"] or 0) - ((p or {}).get("v") or 0), "s", "long")
    assert sorted(((r["k"] or "", r["t"]), r["s"]) for r in out.collect()) == [(("", 1), 103), (("a", 1), 105), (("a", 2), 107), (("b", 1), 100), (("b", 2), 104)]


def test_hash_split_is_xxh64_of_the_text(spark):
    import xxhash

    rows = spark.createDataFrame([("k1",), ("",), (None,), ("long " * 30,)], "k string")
    got = rows.select("k", misc.hash_split("k", 42).alias("a"), misc.hash_split("k", 9).alias("b")).collect()
    for r in got:
        for seed, v in ((42, r["a"]), (9, r["b"])):
            want = None if r["k"] is None else (xxhash.xxh64_intdigest(r["k"].encode(), seed) >> 41) / (1 << 23)
            assert v == want or abs(v - want) < 1e-6


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()[0]
    assert get(string.regexp_replace(F.lit("aXbXc"), "X", "-")) == "a-bXc"
    assert get(string.regexp_match(F.lit("a12b"), r"(\d)(\d)")) == ["1", "2"]
    assert get(string.substring(F.lit("abcdef"), 0, 3)) == "ab"
    assert get(temporal.date_diff("month", F.lit("2024-01-31").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz"))) == 1.0
    assert get(misc.wrap_cast(F.lit(300), "tinyint")) == 44
