"""The pipeline's stages on odd tables: empty ones, nulls alone, clashing names, repeated rows and a very long text."""

from __future__ import annotations

import pytest

from tessera.llm import decontam, queries, quality, resample, secrets, simhash as sim, toxicity

NAMES = ["row_key", "quality_measures", "text_parts", "hit_spans", "__m", "__t", "__drop", "__id", "__row", "row", "key", "fp", "n", "a.b"]
PROSE = "the quick brown fox jumps over the lazy dog while seven kind people watch from a small green boat near town today "


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20))), (2, None)], "item_id long, text string")


def stages(bench, block_words=decontam.BLOCK_WORDS):
    return {"quality": quality.keep_good, "near_dedup": sim.deduplicate, "decontaminate": lambda d: decontam.clean(d, bench, block_words=block_words), "secrets": secrets.redact}


def table(spark, rows):
    extra = ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontaminate", "secrets"])
def test_odd_tables(spark, bench, name):
    run = stages(bench)[name]
    long = PROSE * 9000 + "token = deadbeefdeadbeefdeadbeefdeadbeef " + " ".join(f"item{i}" for i in range(20))
    rows = [(1, long, "en", "s", len(long)), (2, None, None, None, None), (None, None, None, None, None), (3, "", "xx", "", 0), (4, PROSE, "en", "s", len(PROSE)), (4, PROSE, "en", "s", len(PROSE)), (None, "only a few words", "en", None, 16)]
    df = table(spark, rows)
    assert run(df.limit(0)).collect() == []
    out = run(df)
    assert out.columns == df.columns
    got = out.collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in got)
    text = {r["doc_id"]: r["text"] for r in got}
    if name == "quality":  # fewer than twenty words are rejected; the long text repeats itself
        assert ids == [(False, 4), (False, 4)]
    if name == "near_dedup":  # one of the texts without words, one of the equal rows
        assert ids == [(False, 1), (False, 2), (False, 4), (True, 0)]
    if name == "decontaminate":
        assert len(got) == len(rows) and "item7" not in text[1] and text[1].startswith(PROSE) and text[2] is None
    if name == "secrets":
        assert len(got) == len(rows) and "deadbeef" not in text[1] and "[SECRET]" in text[1] and text[3] == ""
    nulls = table(spark, [(None, None, None, None, None)] * 3)
    assert run(nulls).count() == {"quality": 0, "near_dedup": 1}.get(name, 3)


def test_blocks_with_clashing_names(spark, bench):
    df = table(spark, [(1, " ".join(f"item{i}" for i in range(20)) + " " + PROSE * 3, "en", "s", 1)])
    out = stages(bench, 5)["decontaminate"](df)
    assert out.columns == df.columns and "item3" not in out.first()["text"]


def test_operators_with_clashing_names(spark):
    df = table(spark, [(1, PROSE, "en", "s", 1), (None, None, None, None, None)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert resample.resample(df, labels).count() == 2 and toxicity.score(df, labels).count() == 2 and quality.judge(df).count() == 2


def test_whole_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert queries.tokenizer_path()
