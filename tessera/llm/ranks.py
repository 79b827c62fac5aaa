"""Order statistics of distributed long keys by radix histograms: a few bounded rows per pass reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 12


def split_points(rows: DataFrame, node: Column, key: Column, weight: Column, goals: dict, lo: dict, hi: dict, passes: int = 3) -> dict:
    """For each node the smallest key k whose rows of key <= k weigh goals[node] or more.

    Keys lie in [lo, hi] of their node. Each pass cuts a node's remaining range in 4096 and keeps the part that
    holds the goal, so after ``passes`` of them the range has shrunk by 2**(12 * passes), or to one key. Returns
    {node: (key, weight of keys up to it, weight of keys below the last range)}.
    """
    todo = {n: (lo[n], hi[n], goals[n], 0) for n in goals}
    done: dict = {}
    spark = rows.sparkSession
    base = rows.select(node.alias("n"), key.alias("k"), weight.alias("w"))
    for turn in range(passes):
        if not todo:
            break
        plan = []
        for n, (a, b, _, _) in todo.items():
            plan.append((n, a, b, max(1, -(-(b - a + 1) // (1 << STEP)))))
        ranges = spark.createDataFrame(plan, "n int, a long, b long, s long")  # one row per node
        hist = base.join(F.broadcast(ranges), "n").where("k between a and b").groupBy("n", F.expr("(k - a) div s").alias("d")).agg(F.sum("w").alias("w")).collect()
        bins: dict = {}
        for r in hist:
            bins.setdefault(r["n"], []).append((r["d"], r["w"]))
        steps = {n: s for n, _, _, s in plan}
        after = {}
        for n, (a, b, goal, below) in todo.items():
            at, before, s = below, below, steps[n]
            for d, w in sorted(bins.get(n, ())):
                before, at = at, at + w
                if at >= goal:
                    break
            else:
                done[n] = (b, at, before)
                continue
            x, y = a + d * s, min(b, a + (d + 1) * s - 1)
            if s == 1 or turn + 1 == passes:
                done[n] = (y, at, before)
            else:
                after[n] = (x, y, goal, before)
        todo = after
    return done
