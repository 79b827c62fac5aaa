"""Rounding beside SQL, with the sign of zero."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import registry

TINY = -1e-6


@pytest.mark.parametrize("name", ["array_shapes", "vector_shapes", "vector_arithmetic"])
def test_rounding_keeps_the_sign(spark, tmp_path, name):
    e = np.random.default_rng(0).normal(0, 0.1, (200, 64)).astype(np.float32)
    e[:, 3] = -e[:, 0] - e[:, 1] - e[:, 2] + 4 * np.float32(0.123455)  # r2 is close to a tie
    e[::3, 0], e[::5, 3], e[::7, 20] = TINY, TINY, TINY
    pq.write_table(pa.table({"vec_id": pa.array(range(200), pa.int64()), "embedding": pa.array(list(e), pa.list_(pa.float32())), "label": pa.array([0] * 200, pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    result = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    theirs = {r[0]: tuple(r[i] for i in at) for r in result.fetchall()}
    for r in df.collect():
        assert repr([as_plain(x) for x in r]) == repr([as_plain(x) for x in theirs[r["vec_id"]]])


def as_plain(x):
    return [as_plain(v) for v in x] if isinstance(x, (list, tuple)) else float(x)
