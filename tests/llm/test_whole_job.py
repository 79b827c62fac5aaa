"""Whole-job tests of the pipeline's stages against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from brute import AZ, BLANK_WORD

from tessera.llm import decontam, simhash as sim


def jaccard_kept(rows: list[tuple[int | None, str | None]], k: int = 5) -> list[tuple]:
    """Of each component of texts whose sets of k-word shingles have Jaccard 0.8 or more, the smallest doc_id."""
    sets = []
    for _, t in rows:
        w = BLANK_WORD.findall((t or "").translate(AZ))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))})
    group = list(range(len(rows)))
    at = defaultdict(list)
    for i, s in enumerate(sets):
        near = {j for x in s for j in at[x]} if s else {j for j in range(i) if not sets[j]}
        for x in s:
            at[x].append(i)
        for j in near:
            if group[i] != group[j] and 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for i, g in enumerate(group):
        name = (rows[i][0] is None, rows[i][0] or 0, i)
        best[g] = min(best.get(g, name), name)
    return sorted((rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "") for _, _, i in best.values())


def kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_deduplicate_by_jaccard_of_given_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert kept(sim.deduplicate(df)) == jaccard_kept([(r["doc_id"], r["text"]) for r in df.collect()])


def test_deduplicate_large_group_of_unlike_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in rng.sample(range(150), rng.randint(0, 6)):
            w[j] = f"v{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(sim.deduplicate(df)) == jaccard_kept(rows)


@pytest.mark.parametrize("block_words", [1, 14, 40])
def test_cleaning_does_not_depend_on_blocks(spark, block_words):
    p, q = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    over = p[20:] + [f"c{i}" for i in range(10)]
    items = [(1, " ".join(p)), (2, " ".join(q)), (3, " ".join(over))]
    other = [f"x{i}" for i in range(40)]
    rows = [
        (1, " ".join(p + other + q)),  # 60 of 100 words, 30 from each of two items
        (2, " ".join(other + p + over[10:] + ["end"] + other)),  # items 1 and 3 overlap
        (3, " ".join(other)),
        (4, None),
    ]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontam.clean(df, bench, block_words=block_words).collect()}
    cut = " ".join(other) + "  end " + " ".join(other)
    assert got == {2: (cut, len(cut)), 3: (rows[2][1], len(rows[2][1])), 4: (None, 0)}


def test_deduplicate_repeated_and_null_ids(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red blue green white black grey"
    rows = [(1, a), (2, a), (2, b), (1, a), (None, a), (3, c), (3, c), (None, "only a null id here now"), (None, "only a null id here now"), (4, None), (5, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, a), (2, b), (3, c), (4, None), (None, "only a null id here now")]
    assert kept(sim.deduplicate(df)) == sorted((i is None, i or 0, t or "") for i, t in want)


def test_deduplicate_sets_inside_others_at_the_threshold(spark):
    rows = []
    for i in range(40):
        w = [f"u{i}x{j}" for j in range(104)]
        rows += [(2 * i, " ".join(w[:84])), (2 * i + 1, " ".join(w))]  # 80 of 100 shingles
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(sim.deduplicate(df)) == jaccard_kept(rows) == kept(df.where("doc_id % 2 = 0"))


def test_rows_are_taken_without_a_shuffle_of_them(spark, monkeypatch):
    ids = [0, 1, 32767, 32768, 32769, (7 << 33) + 5]
    rows = spark.createDataFrame([(x, f"t{x}") for x in [*ids, 2, 3 << 33, (7 << 33) + 6]], "row_key long, text string")
    wanted = spark.createDataFrame([(x,) for x in ids], "k long")
    for _ in range(2):
        got = [sorted(r["row_key"] for r in sim.among(rows, "row_key", wanted, inside).collect()) for inside in (True, False)]
        assert got == [sorted(ids), [2, 3 << 33, (7 << 33) + 6]]
        monkeypatch.setattr(sim, "BITMAPS", 0)  # the way for more bitmaps than can be broadcast
    monkeypatch.undo()
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sim.deduplicate(df)
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]
        assert "Exchange hash" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_odd_bits_differ_in_no_more_places_than_sets():
    rng = random.Random(3)
    for n in (0, 1, 40, 900):
        a = {rng.getrandbits(64) for _ in range(n)}
        b = {x for x in a if rng.random() < 0.9} | {rng.getrandbits(64) for _ in range(5)}
        x, y = (sim.odd_bits(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a ^ b)
