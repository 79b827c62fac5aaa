"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds by query."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "flagship filter_predicates let_bindings case_expressions join_inner join_left join_semi join_anti join_asof subquery_in subquery_exists subquery_scalar union_distinct intersect_distinct except_distinct "
    "topk distinct_rows agg_basic agg_distinct agg_percentile pivot_single pivot_discovered unpivot_rows window_rank window_frames qualify scan_sessions scan_ema cte_multi cte_recursive "
    "sample_balanced string_basic temporal_arithmetic array_lambdas vector_topk fulltext_match profile_numeric copy_parquet"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from tessera.plans import registry

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # the second run has compiled code
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 4)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
