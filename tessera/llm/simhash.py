"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints are masked in six ways: of four 16-bit blocks two are kept. Two fingerprints that differ in at most
two bits agree under at least one mask, so the shared masked patterns are the index's upper nodes, and each node
is searched alone. Inside a node the fingerprints are sorted by Gray rank; runs of them form a tree whose nodes
hold the bits that all below share, and pairs of nodes are pruned as soon as the differences of their shared bits
exceed the radius. A node of more than ``NODE`` fingerprints is not searched in one task: its members meet at
their one-bit neighbours instead. Two fingerprints within two bits share such a neighbour, a neighbour has at
most 65 of them, so that way is exact and bounded whatever the data.

Nodes return only links to one member of each local component; components over all nodes are found with
alternating star contraction, stored in the shared folder each round.

Defined results: null and empty texts have the zero fingerprint and link like any other; rows with equal doc_id
are kept each; a null doc_id takes the component of its fingerprint and is never its name (a component of nulls
alone has none); an empty table gives no rows; other columns are ignored.

``deduplicate``, the pipeline's stage, has another law: exact Jaccard similarity of five-word shingle sets. The
Gray-order index joins the groups whose fingerprints are near first; a prefix-filter join finds all the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import vec
from .common import discard, free_name, materialize, ship

SEED = 42
RADIUS = 2
NODE = 4096
FANOUT = 8
#: Near-duplicates of the pipeline: words of a shingle, and least Jaccard similarity as a fraction.
SHINGLE = 5
SIMILAR = (4, 5)
HEADS = 4
#: Lists of more keys than this are tested against heads first.
LONG = 8
#: Bitmaps, 4 kB each, that are broadcast at most; beyond, rows are found by a join.
BITMAPS = 8192
#: Columns of 64 bits each, of which a set's odd bits are made up.
ODD = ("odd0", "odd1", "odd2", "odd3")
PAIRS_AT_ONCE = 1 << 20
MASKS = [sum(0xFFFF << (16 * b) for b in (i, j)) for i in range(4) for j in range(i + 1, 4)]


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of the bits of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = 3) -> np.ndarray:
    """The fingerprint of each text: shingles of ``k`` words, lower-cased in ASCII, with repeats."""
    data = vec.LOWER[data]
    starts, ends, first = vec.words(data, offsets, vec.BLANK_WORDS)
    keep = vec.BLANK_WORDS[data] if len(data) else np.zeros(0, bool)
    keep[ends[ends < len(data)]] = True  # one space after each word
    spaced = np.where(vec.BLANK_WORDS[data], data, np.uint8(32)) if len(data) else data
    rank = np.concatenate([[0], np.cumsum(keep)])
    raw = spaced[keep].tobytes()
    a, b = rank[starts], rank[ends]
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    al, bl = a.tolist(), b.tolist()
    for t, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if j - i >= k:
            h = [digest(raw[x:y], SEED) for x, y in zip(al[i : j - k + 1], bl[i + k - 1 : j])]
        elif j > i:
            h = [digest(raw[al[i] : bl[j - 1]], SEED)]
        else:
            continue
        out[t] = fingerprint(np.array(h, np.uint64))
    return out


def with_fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long ``fp``."""

    def run(iterator):
        for ids, text in vec.batches(iterator, "doc_id", "text"):
            data, offsets = vec.text_bytes(text)
            parts = [fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k) for i, j in vec.chunks(offsets)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def node_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places i < j in ``fps`` (distinct, in Gray order) within ``radius`` bits, by the tree of shared bits."""
    levels = [(np.full(len(fps), np.uint64(0xFFFFFFFFFFFFFFFF)), fps)]
    while len(levels[-1][1]) > 1:
        mask, pattern = levels[-1]
        cuts = np.arange(0, len(pattern), FANOUT)
        ones = np.bitwise_and.reduceat(pattern & mask, cuts)
        zeros = np.bitwise_and.reduceat(~pattern & mask, cuts)
        levels.append((ones | zeros, ones))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE // FANOUT**2 and len(a) > 1:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        mask, pattern = levels[level]
        near = _ones((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level == 0:
            keep = a < b
            out.append((a[keep], b[keep]))
            continue
        n = len(levels[level - 1][1])
        grid = np.arange(FANOUT)
        x = (a[:, None, None] * FANOUT + grid[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
        y = (b[:, None, None] * FANOUT + grid[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
        keep = (x < n) & (y < n) & (x <= y)
        stack.append((level - 1, x[keep], y[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def node_stars(fps: np.ndarray) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its local component) for members that aren't their component's name."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    i, j = node_links(fps)
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
    signed = fps.view(np.int64)
    least: dict[int, int] = {}
    for x in range(len(fps)):
        r = root(x)
        least[r] = min(least.get(r, int(signed[x])), int(signed[x]))
    return [(int(signed[x]), least[root(x)]) for x in range(len(fps)) if least[root(x)] != int(signed[x])]


def links(distinct: DataFrame, node: int = NODE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within two bits.

    ``distinct`` holds each fingerprint once, as ``fp``.
    """
    masked = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("p")) for k, m in enumerate(MASKS)])).alias("x")).select("fp", "x.m", "x.p")
    counts = masked.groupBy("m", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(counts, "simhash-nodes")
    members = masked.join(sizes.where(F.col("n") <= node).select("m", "p"), ["m", "p"])

    def run(iterator):
        for (nodes,) in vec.batches(iterator, "fps"):
            flat, at = nodes.values.to_numpy().view(np.uint64), nodes.offsets.to_numpy()
            stars = [s for i, j in zip(at[:-1].tolist(), at[1:].tolist()) for s in node_stars(flat[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([y for _, y in stars], pa.int64())], ["a", "b"])

    # lists are of at most `node` fingerprints, as the sizes have shown
    found = members.groupBy("m", "p").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "a long, b long")
    if sizes.where(F.col("n") > node).limit(1).count():
        crowded = masked.join(sizes.where(F.col("n") > node).select("m", "p"), ["m", "p"]).select("fp").distinct()
        around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
        near = crowded.select("fp", F.explode(around).alias("c"))
        w = near.groupBy("c").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        found = found.union(w.select(F.explode("all").alias("a"), "b").where("a != b"))
    return found.distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in the edges that isn't its component's smallest: alternating star contraction.

    Each round is stored in the shared folder; the rounds grow with the logarithm of the largest component. Edges are
    counted and summed by hash while they are stored: two rounds with equal figures are the last.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "cc")
        return out, (seen.get["n"], seen.get["h"])

    now, state = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while True:
        # large star: link every larger neighbour to the smallest of the neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: link the smaller neighbours, and the node itself, to the smallest of them
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(lower.select("a", F.col("m").alias("b"))).distinct()
        last, before = state, now
        now, state = kept(small)
        discard(before)
        if state == last:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 3, node: int = NODE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``."""
    ship(docs.sparkSession)
    fps = materialize(with_fingerprints(docs, k), "simhash-fp")
    named = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(named.select("fp"), node)).select(F.col("id").alias("fp"), "root")
    placed = named.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    mapping = materialize(placed.join(names, "root").select("fp", "component_id"), "simhash-map")
    return fps.join(mapping, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles of ``k`` words as sorted hashes, lower-cased in ASCII; a shorter text is one shingle."""
    data = vec.LOWER[data]
    starts, ends, first = vec.words(data, offsets, vec.BLANK_WORDS)
    h = vec.mix(vec.Hasher(data)(starts, ends))
    made = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        made = vec.pair(made, h[j : j + len(made)])
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= k:
            out.append(np.unique(made[i : j - k + 1]))
        elif j > i:
            whole = np.array([j - i], np.uint64)
            for x in h[i:j]:
                whole = vec.pair(whole, np.array([x]))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(column, k: int):
    data, offsets = vec.text_bytes(column)
    for i, j in vec.chunks(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is 0.8 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * shared >= SIMILAR[0] * (len(a) + len(b) - shared)


def _common(rows: DataFrame, row: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sixteenth of the rows, and their ranks by frequency.

    They only order the shingles within a set. Any order finds the same pairs; this one keeps the lists short.
    """

    def run(iterator):
        for (text,) in vec.batches(iterator, "text"):
            data, offsets = vec.text_bytes(text)
            for i, j in vec.chunks(offsets):
                s = np.concatenate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    part = rows.where(F.pmod(F.xxhash64(row), F.lit(16)) == 0).select(F.col("text").cast("string").alias("text"))
    least = max(3, part.count() // 20_000)
    counted = materialize(part.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "dedup-common")
    found = counted.toPandas()
    discard(counted)
    s, n = found["s"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy()
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, n))] = np.arange(len(s))
    order = np.argsort(s)
    return s[order], rank[order]


def odd_bits(s: np.ndarray) -> np.ndarray:
    """256 bits as four words: which values of the mixed hashes' upper bits occur an odd number of times."""
    n = np.bincount((vec.mix(s) >> np.uint64(56)).astype(np.int64), minlength=256)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").view("<u8")


def with_prefixes(rows: DataFrame, row: str, k: int) -> DataFrame:
    """row, doc_id, ``key`` (names the shingle set), ``fp`` (its fingerprint), ``n`` (its size), ``odd0`` to ``odd3`` and ``prefix``.

    A set of n shingles shares at least 0.8 n with a similar one, so both have a shingle in common among the first
    n - ceil(0.8 n) + 1, the prefix, in one order for all. Rare shingles come first. A bit of the ``odd`` is 1 if an
    odd number of the shingles fall to it, so two sets have at least as many different shingles as different bits.
    """
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, row, k))

    def run(iterator):
        names, ranks = common.value
        for at_row, ids, text in vec.batches(iterator, "row", "doc_id", "text"):
            data, offsets = vec.text_bytes(text)
            for i, j in vec.chunks(offsets):  # small batches out: the lists of one chunk are held at a time
                keys, fps, sizes, odds, prefixes = [], [], [], [], []
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    keys.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0)
                    fps.append(fingerprint(s))
                    sizes.append(len(s))
                    odds.append(odd_bits(s))
                    if len(s) and len(names):
                        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                        s = s[np.argsort(np.where(names[at] == s, ranks[at], -1), kind="stable")]
                    prefixes.append(s[: len(s) - -(-SIMILAR[0] * len(s) // SIMILAR[1]) + 1].view(np.int64).copy())
                at = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int64()))
                words = np.array(odds, np.uint64).reshape(-1, len(ODD)).T
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps, sizes, *words)]
                yield pa.RecordBatch.from_arrays([at_row.slice(i, j - i), ids.slice(i, j - i), *longs, lists], ["row", "doc_id", "key", "fp", "n", *ODD, "prefix"])

    texts = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"row long, doc_id long, key long, fp long, n long, {', '.join(f'{q} long' for q in ODD)}, prefix array<long>")


def _bitmaps(keys: DataFrame) -> DataFrame:
    """``bucket`` and ``bits`` (4 kB): the values of ``k``, none of them negative. Buckets of 32,768 values start at 1 with 1."""
    # dealt by bucket first, so that each bitmap is made once
    dealt = keys.select(F.bitmap_bucket_number("k").alias("bucket"), F.bitmap_bit_position("k").alias("at")).repartition("bucket")
    return dealt.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def among(rows: DataFrame, row: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """The ``rows`` whose key ``row`` is in the one column of ``wanted``, or else the others; ``rows`` aren't shuffled.

    Keys are of ``monotonically_increasing_id``, so a bitmap holds many; where there are too many bitmaps to broadcast
    the rows are joined.
    """
    keys = wanted.toDF("k")
    bits = materialize(_bitmaps(keys), "dedup-bits")
    if bits.count() > BITMAPS:
        discard(bits)
        return rows.join(keys, F.col(row) == F.col("k"), "left_semi" if inside else "left_anti")
    names = [free_name(rows, "__bucket"), free_name(rows, "__bits")]
    bucket, held = (F.col(n) for n in names)
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_in = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    met = rows.join(F.broadcast(bits.toDF(*names)), F.bitmap_bucket_number(row) == bucket, "inner" if inside else "left")
    return met.where(is_in if inside else ~is_in).drop(*names)


def verified(pairs: DataFrame, named: DataFrame, rows: DataFrame, row: str, k: int) -> DataFrame:
    """Those pairs of keys (a, b) whose texts' shingle sets are similar; each pair's texts are compared exactly.

    Only texts that are in some pair are read out of ``rows``; ``named`` has one row for each key.
    """
    pairs = materialize(pairs, "dedup-pairs")
    placed = pairs.join(named.select(F.col("key").alias("a"), F.col("row").alias("ra")), "a").join(named.select(F.col("key").alias("b"), F.col("row").alias("rb")), "b")
    placed = materialize(placed, "dedup-placed")
    texts = among(rows.select(row, F.col("text").cast("string").alias("text")), row, placed.select(F.explode(F.array("ra", "rb"))).distinct())
    texts = materialize(texts, "dedup-texts")

    def run(iterator):
        for a, b, x, y in vec.batches(iterator, "a", "b", "x", "y"):
            keep = pa.array([similar(s, t) for s, t in zip(_sets(x, k), _sets(y, k))], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    both = placed.join(texts.select(F.col(row).alias("rb"), F.col("text").alias("y")), "rb").join(texts.select(F.col(row).alias("ra"), F.col("text").alias("x")), "ra")
    out = materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "dedup-edges")
    discard(pairs, placed, texts)
    return out


def _near_fingerprints(keyed: DataFrame, node: int) -> DataFrame:
    """Pairs (a, b): each key with the smallest key of a fingerprint that the Gray-order index has linked to its own."""
    heads = materialize(keyed.groupBy("fp").agg(F.min("key").alias("a")), "dedup-heads")
    linked = links(heads.select("fp"), node).groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("to"))
    to = heads.join(linked, "fp", "left").select("fp", F.coalesce("to", "fp").alias("to")).join(heads.select(F.col("fp").alias("to"), "a"), "to").select("fp", "a")
    return keyed.join(to, "fp").where("a != key").select("a", F.col("key").alias("b"))


def _may_meet():
    """No two sets with a common shingle at places ``ix`` and ``iy`` are similar unless this holds.

    What is common before that place stands in the prefixes of both, hence in lists that aren't done: it is one of the
    ``ex`` of the one set and of the ``ey`` of the other. So is what is common after it in both prefixes, one of ``fx``
    and ``fy``; one prefix ends first, and of its set only the rest can be common besides. Similar sets have 4/9 of
    ``nx + ny`` in common, so at most 1/9 is in one of them only.
    """
    return F.expr(
        f"5 * nx >= 4 * ny and 5 * ny >= 4 * nx and 9 * ({' + '.join(f'bit_count({q}x ^ {q}y)' for q in ODD)}) <= nx + ny"
        " and 9 * (least(ex, ey) + least(nx - ix, ny - iy, least(fx, fy) + greatest((4 * nx + 4) div 5, (4 * ny + 4) div 5))) >= 4 * (nx + ny)"
    )


def _may_be_similar():
    """No two sets with ``m`` common shingles in their prefixes, the last at ``ix`` and ``iy``, are similar unless this holds.

    Besides the ``m`` only what follows the last can be common. One of the two prefixes ends first in the order; of the
    set it belongs to, only what follows the prefix can be.
    """
    return F.expr("9 * (m - 1 + least(nx - ix, ny - iy, greatest((4 * nx + 4) div 5, (4 * ny + 4) div 5))) >= 4 * (nx + ny)")


def _posts(sets: DataFrame) -> DataFrame:
    """(s, key, i): each prefix shingle that several sets have, and its place in each."""
    shared = sets.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("s")
    shared = materialize(shared, "dedup-shared")
    # most shingles are in one prefix only: a bitmap of the others' remainders spares the join nearly all of these
    buckets = min(BITMAPS, 1 + shared.count() * 16 // 32768)
    held = materialize(_bitmaps(shared.select((F.pmod("s", F.lit(buckets * 32768)) + 1).alias("k")).distinct()), "dedup-bits")
    packed = np.zeros((buckets, 4096), np.uint8)
    for r in held.toLocalIterator():
        packed[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    discard(held)
    sent = sets.sparkSession.sparkContext.broadcast(packed.ravel())

    def run(iterator):
        bits = sent.value
        for keys, prefixes in vec.batches(iterator, "key", "prefix"):
            s, ends = prefixes.values.to_numpy(), prefixes.offsets.to_numpy()
            at = s[ends[0] : ends[-1]] % np.int64(len(bits) * 8)
            sizes = np.diff(ends)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            i = keep - (ends[:-1] - ends[0])[owner[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(s[ends[0] + keep]), keys.take(pa.array(owner[keep])), pa.array(i.astype(np.int32))], ["s", "key", "i"])

    posts = materialize(sets.select("key", "prefix").mapInArrow(run, "s long, key long, i int").join(shared, "s"), "dedup-posts")
    discard(shared)
    return posts


def similar_sets(rows: DataFrame, row: str, sets: DataFrame, k: int, node: int = NODE) -> DataFrame:
    """(key, root) of the components of all pairs of shingle sets with Jaccard similarity 0.8 or more.

    Groups whose fingerprints are near are joined first, through the index. Keys that share a prefix shingle are
    candidates for the rest, unless the shingles' places in the two sets rule the pair out. While lists are long, a round draws ``HEADS`` heads for each long list by hashes of keys and tests each key against those that it shares
    most shingles with, which joins most of a group; lists within one component are done. At last all pairs that aren't
    joined yet are tested.
    """
    spark = rows.sparkSession
    named = materialize(sets.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("n").alias("n"), *[F.first(q).alias(q) for q in ODD]), "dedup-keys")
    posts = _posts(among(sets, "row", named.select("row")))
    n_keys, n_posts = named.count(), posts.count()
    new = verified(_near_fingerprints(named.select("key", "fp"), node), named, rows, row, k)
    roots, turn, last = spark.createDataFrame([], "key long, root long"), 0, False
    while True:
        found = new.count()
        if found:
            old, roots = roots, materialize(components(new.union(roots.select("key", "root"))).select(F.col("id").alias("key"), "root"), "dedup-roots")
            discard(old)
        discard(new)
        if last:
            discard(posts, named)
            return roots
        placed = posts.join(roots, "key", "left").select("s", "key", "i", F.coalesce("root", "key").alias("c"))
        open_lists = placed.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("s").agg(F.count(F.lit(1)).alias("own"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm")).where("own > 1")
        open_lists = materialize(open_lists, "dedup-open")
        left, longest = open_lists.agg(F.sum((F.col("m") * F.col("m") - F.col("mm")) / 2), F.max("m")).first()
        # of what stands before and after a shingle only what is in open lists can be common with another component
        before = F.row_number().over(Window.partitionBy("key").orderBy("i")) - 1
        live = placed.join(open_lists.select("s", "m"), "s").withColumn("e", before)
        live = live.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("key")) - F.col("e") - 1)
        live = materialize(live.join(named.select("key", "n", *ODD), "key"), "dedup-live")
        discard(posts)
        posts = live
        last = (longest or 0) <= LONG or turn > 0 and ((left or 0) <= LONG // 2 * n_posts or found * 1000 < n_keys)
        places = ("i", "e", "f", *ODD)
        if last:
            x, y = (live.select("s", *[F.col(q).alias(q + z) for q in ("key", "n", "c", *places)]) for z in "xy")
            met = x.join(y, "s").where((F.col("keyx") < F.col("keyy")) & (F.col("cx") != F.col("cy")) & _may_meet())
        else:
            # a draw by keys is likely to fall in the largest component, which the rest is then tested against
            draws = [F.min_by(F.struct("c", "key", "n", *places), F.struct(F.xxhash64("key", F.lit(turn * HEADS + d)), "key")).alias(f"h{d}") for d in range(HEADS)]
            crowded = live.where(F.col("m") > LONG)
            heads = crowded.groupBy("s").agg(*draws)
            met = crowded.join(heads, "s").select("key", "n", "c", *places, F.explode(F.array_distinct(F.array(*[f"h{d}" for d in range(HEADS)]))).alias("h")).where("c != h.c")
            met = met.select(*[F.col(f"h.{q}").alias(q + "x") for q in ("key", "n", *places)], *[F.col(q).alias(q + "y") for q in ("key", "n", *places)]).where(_may_meet())
        pairs = met.groupBy("keyx", "keyy", "nx", "ny").agg(F.count(F.lit(1)).alias("m"), F.max("ix").alias("ix"), F.max("iy").alias("iy")).where(_may_be_similar())
        if last:
            pairs = pairs.select(F.col("keyx").alias("a"), F.col("keyy").alias("b"))
        else:
            best = pairs.groupBy(F.col("keyy").alias("b")).agg(F.slice(F.sort_array(F.collect_list(F.struct("m", "keyx")), asc=False), 1, HEADS).alias("x"))
            pairs = best.select(F.explode("x.keyx").alias("a"), "b")
        new, turn = verified(pairs, named, rows, row, k), turn + 1
        discard(open_lists)


def deduplicate(docs: DataFrame, k: int = SHINGLE, node: int = NODE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest doc_id.

    Near-duplicates have shingle sets of ``k`` words with a Jaccard similarity of 0.8 or more; groups are components.
    A text of fewer words, however few, is one shingle; texts without words, empty and null ones, are one group.
    Rows have a stored key of their own: of rows with equal doc_id one stays, and a row without a doc_id stays only
    if no row of its group has one. Whole texts are read, whatever their length; a text's sets are held one at a
    time. An empty table stays empty; columns are passed on whatever their names.
    """
    ship(docs.sparkSession)
    row = free_name(docs, "row_key")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-rows")
    sets = materialize(with_prefixes(rows, row, k), "dedup-sets")
    placed = sets.join(similar_sets(rows, row, sets, k, node), "key", "left").select("row", "doc_id", F.coalesce("root", "key").alias("root"))
    placed = materialize(placed, "dedup-groups")
    discard(sets)
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1").select("root", F.col("x.row").alias("best"))
    drop = placed.join(best, "root").where("row != best").select(F.col("row").alias(row))
    return among(rows, row, drop, inside=False).select(*[F.col(f"`{c}`") for c in docs.columns])
