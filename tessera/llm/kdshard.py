"""K-d tree shards: split at weighted medians along the widest metadata dimension until leaves reach their bytes.

Points are groups of equal texts, weighed by their bytes, so copies stay in one shard. A group of more than ``HEAVY``
of a shard would upset a median: such groups, of which there are a bounded number, are dealt to the leaves first,
largest first to the emptiest, and the tree splits the rest at the bytes that each leaf still lacks. Only a group
that outweighs ``WHOLE`` of a shard is cut, into as few parts as that share allows: no law of equal sizes could hold
with it whole. Dimensions are the language, the source and the size; a hash of the text orders points that tie. Each level of
the tree takes three passes of histograms; 4096 counts a node reach the driver, whatever the input.

The law is ``bytes``: shards' sizes are near equal.

Defined results: a null text has no bytes and counts 8, as an empty one; null lang or source is a value of its
own; repeated rows are kept each and get slots of their own; null doc_ids sort first; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .ranks import split_points

DIMENSIONS = ("lang", "source", "size")
#: Share of a shard's bytes beyond which a group of equal texts is dealt to a leaf before the tree is built.
HEAVY = 0.02
#: Share of a shard's bytes beyond which a group can't stay whole.
WHOLE = 0.95
#: Bits of a point's key below its place in a dimension: the hash of the text.
TIE = 40
ROWS_A_SLOT_BUCKET = 50_000


def _size_place():
    """The size as a whole number below 2**20: 2**14 steps per power of e, so that all sizes below 2**64 fit."""
    return F.least(F.lit((1 << 20) - 1), F.floor(F.log1p(F.col("size").cast("double")) * (1 << 14))).cast("long")


def tree(points: DataFrame, wanted: list[float]) -> list[tuple]:
    """Splits (node, dimension, key) in the order made; ``points`` has columns k_* and weight, leaves the bytes ``wanted``.

    Node ids are those of a heap: the children of n are 2n and 2n + 1; a split sends keys up to its key to the left.
    """
    parts, first = {1: len(wanted)}, {1: 0}
    splits: list[tuple] = []
    where = F.lit(1)
    while any(k > 1 for k in parts.values()):
        node = where.cast("int")
        spans = points.groupBy(node.alias("n")).agg(*[f(f"k_{d}").alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)], F.sum("weight").alias("w")).collect()
        goals, lo, hi, dim, leaf = {}, {}, {}, {}, {}
        for r in spans:  # one row per node
            n = r["n"]
            if parts.get(n, 1) < 2:
                continue
            width = {d: (r[f"max_{d}"] >> TIE) - (r[f"min_{d}"] >> TIE) for d in DIMENSIONS}
            d = max(DIMENSIONS, key=lambda x: (width[x], -DIMENSIONS.index(x)))
            left = parts[n] // 2
            dim[n], lo[n], hi[n], leaf[n] = d, r[f"min_{d}"], r[f"max_{d}"], left
            here = wanted[first[n] : first[n] + parts[n]]
            goals[n] = r["w"] * (sum(here[:left]) / sum(here) if sum(here) else left / parts[n])
        if not goals:
            break
        key = F.coalesce(*[F.when(node == n, F.col(f"k_{d}")) for n, d in dim.items()])
        found = split_points(points.where(node.isin(list(goals))), node, key, F.col("weight"), goals, lo, hi, passes=5)
        step = where
        for n, (k, at, before) in found.items():
            # the last range may be passed or not, whichever is nearer to the goal
            if abs(before - goals[n]) < abs(at - goals[n]) and before > 0:
                k = _below(points, node, key, n, k)
            splits.append((n, dim[n], k))
            step = F.when(node == n, F.when(F.col(f"k_{dim[n]}") <= k, 2 * n).otherwise(2 * n + 1)).otherwise(step)
            parts[2 * n], parts[2 * n + 1] = leaf[n], parts[n] - leaf[n]
            first[2 * n], first[2 * n + 1] = first[n], first[n] + leaf[n]
        for n in [n for n in parts if parts[n] > 1 and n not in found and n in goals]:
            parts[n] = 1
        for n in found:
            parts[n] = 0
        where = _route(splits)
        if not found:
            break
    return splits


def _below(points, node, key, n: int, k: int) -> int:
    least = points.where((node == n) & (key < k)).agg(F.max(key)).first()[0]
    return k - 1 if least is None else least


def _route(splits: list[tuple]):
    """The heap id of a point's leaf."""
    by = {n: (d, k) for n, d, k in splits}

    def go(n: int):
        if n not in by:
            return F.lit(n)
        d, k = by[n]
        return F.when(F.col(f"k_{d}") <= k, go(2 * n)).otherwise(go(2 * n + 1))

    return go(1)


def _leaves(splits: list[tuple], shards: int) -> dict[int, int]:
    """Shard numbers of leaves, left to right; a leaf that couldn't be split leaves numbers unused."""
    by, out = {n for n, _, _ in splits}, {}

    def go(n: int, first: int, k: int) -> None:
        if n not in by:
            out[n] = first
        else:
            go(2 * n, first, k // 2)
            go(2 * n + 1, first + k // 2, k - k // 2)

    go(1, 0, shards)
    return out


def deal(groups: list[tuple], target: float, shards: int, whole: float) -> tuple[list[tuple], list[float]]:
    """Leaves of heavy groups: (key, parts, part, leaf) and the bytes that each leaf has of them.

    Groups come as (key, bytes). Those above ``whole`` of the target are cut in equal parts.
    """
    pieces = []
    for key, weight in groups:
        m = max(1, math.ceil(weight / (whole * target)))
        pieces += [(weight / m, key, m, part) for part in range(m)]
    load, out = [0.0] * shards, []
    for weight, key, m, part in sorted(pieces, key=lambda x: (-x[0], x[1], x[3])):
        leaf = min(range(shards), key=lambda i: (load[i], i))
        load[leaf] += weight
        out.append((key, m, part, leaf))
    return out, load


def shard(docs: DataFrame, shards: int = 24, heavy: float = HEAVY, whole: float = WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    raw = F.coalesce(F.encode(text, "utf-8"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("x"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "kd-rows")
    key = ["size", "text_crc32", "x"]
    groups = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source")), "kd-groups")
    totals = groups.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    total, count = totals[0] or 0, totals[1] or 0
    target = total / shards
    weight = F.col("size") * F.col("n")
    is_heavy = (F.col("n") > 1) & (weight > max(1.0, heavy * target))
    # fewer than shards / heavy groups can outweigh that share of a shard
    fixed, load = deal([((r["size"], r["text_crc32"], r["x"]), r["size"] * r["n"]) for r in groups.where(is_heavy).collect()], target, shards, whole)
    pinned = F.broadcast(spark.createDataFrame([(*k, m, p, leaf) for k, m, p, leaf in fixed], "size long, text_crc32 long, x long, parts int, part int, pin int"))
    points = groups.where(~is_heavy).select(*key, weight.alias("weight"), "lang", "source")
    ranks = {}
    for d in ("lang", "source"):
        ranks[d] = _ordinals(groups, d)
    tie = F.pmod(F.xxhash64("text_crc32", "x"), F.lit(1 << TIE))
    place = {d: F.coalesce(_bucket(d, ranks[d]), F.lit(0)) if d in ranks else _size_place() for d in DIMENSIONS}
    keyed = materialize(points.select(*key, "weight", *[(place[d].cast("long") * (1 << TIE) + tie).alias(f"k_{d}") for d in DIMENSIONS]), "kd-points")
    splits = tree(keyed, [max(0.0, target - x) for x in load])
    leaf = _leaves(splits, shards)
    number = F.coalesce(*[F.when(F.col("leaf") == n, F.lit(s)) for n, s in leaf.items()])
    placed = keyed.withColumn("leaf", _route(splits)).select(*key, number.cast("int").alias("at"))
    dealt = rows.join(F.broadcast(pinned.groupBy(*key).agg(F.first("parts").alias("parts"))), key, "left")
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))).drop("parts")
    dealt = dealt.join(pinned.drop("parts"), [*key, "part"], "left")
    out = dealt.where("pin IS NULL").join(placed, key).withColumn("shard", F.col("at")).drop("at").unionByName(dealt.where("pin IS NOT NULL").withColumn("shard", F.col("pin")))
    out = out.select("row", "doc_id", "size", "text_crc32", "shard")
    buckets = max(1, -(-count // (shards * ROWS_A_SLOT_BUCKET)) * 8)
    out = materialize(out.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")), "kd-placed")
    discard(rows, groups, keyed)
    sizes = out.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("c"))
    first = sizes.select("shard", "bucket", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "row")) - 1
    slotted = out.withColumn("r", within).join(first, ["shard", "bucket"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _ordinals(groups: DataFrame, d: str, values: int = 1024) -> list[str]:
    """The values of a label dimension in order, if there are few; else points that cut them in even parts."""
    seen = groups.select(d).where(F.col(d).isNotNull()).distinct().orderBy(d)
    few = [r[0] for r in seen.limit(values + 1).collect()]
    if len(few) <= values:
        return few
    cuts = seen.select(d, F.pmod(F.xxhash64(d), F.lit(1 << 30)).alias("h")).orderBy("h", d).limit(values)
    return sorted(r[0] for r in cuts.collect())


def _bucket(d: str, values: list[str]):
    """How many of the sorted values are at or below a label, spread over 2**20 places; a null is 0."""
    if not values:
        return F.lit(0)
    step = max(1, ((1 << 20) - 1) // len(values))
    known = F.array(*[F.lit(v) for v in values])
    at = F.array_position(known, F.col(d))
    return F.when(F.col(d).isNull(), 0).when(at > 0, at * step).otherwise(F.size(F.filter(known, lambda v: v <= F.col(d))) * step)
