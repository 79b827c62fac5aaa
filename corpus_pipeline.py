"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm import decontam, packing, quality, secrets, simhash
from tessera.llm.common import materialize, read_table
from tessera.llm.queries import tokenizer_path


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs)


def decontam_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist of them go."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("decontaminate", decontam_stage), ("secrets", secrets_stage), ("pack", packing_stage)]

#: Inferred grammars, tokenizers and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
