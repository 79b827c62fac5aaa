"""Queries against their oracles: ``python tests/oracle.py [folder] [names]`` prints those that differ."""

from __future__ import annotations

import datetime
import decimal
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value that is equal for both engines."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal, float)) or hasattr(x, "dtype"):
        v = float(x)
        return "nan" if v != v else round(v, 4) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def table(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, query, sql: str) -> str | None:
    df = query(spark, folder)
    ours = table(df.columns, df.collect())
    result = con.execute(sql)
    theirs = table([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"{name}: columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        odd = next(((a, b) for a, b in zip(ours[1], theirs[1]) if a != b), None)
        return f"{name}: {len(ours[1])} and {len(theirs[1])} rows; first that differ: {odd}"
    return None


def main() -> None:
    import time
    import traceback

    from pyspark.sql import SparkSession

    from tessera.plans import registry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = duck(folder), registry.oracle_sql(), 0
    for name, q in registry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, folder, name, q, sqls[name])
            else:
                said = None if q(spark, folder).count() >= 0 else "no rows"
        except Exception as e:
            said = f"{name}: {type(e).__name__} {str(e)[:500]} {traceback.format_exc().splitlines()[-1][:100]}"
        bad += bool(said)
        print(f"{'BAD ' + said[:900] if said else 'ok  ' + name} ({time.time() - began:.1f} s)", flush=True)
    print(bad, "bad")


if __name__ == "__main__":
    main()
