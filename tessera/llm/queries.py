"""One thin query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontam, kdshard, licenses, packing, pfor, quality, resample, secrets, simhash, toxicity
from .common import read_table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_kd_shards(spark, sf_dir: str) -> DataFrame:
    return kdshard.shard(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return pfor.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontam.detect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).withColumn("doc_id", F.col("doc_id").cast("long"))


def quality_base(spark, sf_dir: str) -> DataFrame:
    """What op4 measures before its method judges: SQL can say it."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base(spark, sf_dir: str) -> DataFrame:
    """The phrases of op7."""
    return licenses.phrases(read_table(spark, sf_dir, "documents"))


def secret_base(spark, sf_dir: str) -> DataFrame:
    """The counts of op8's base rules."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_sizes(spark, sf_dir: str) -> DataFrame:
    """Rows, bytes, shards and places of op2."""
    return op2_kd_shards(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.countDistinct("shard").alias("shards"), F.countDistinct("shard", "slot").alias("places"))


QUALITY_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    k AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM t),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k WHERE len(k) = 8) WHERE c > 1),
    h AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(8) AS g(j) GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(h.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(h.n, 0) > 30 * len(w) AS base_failed FROM w LEFT JOIN h ON w.doc_id = h.doc_id"""

LICENSE_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
    n AS (SELECT *, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
    f AS (SELECT doc_id, i, CASE WHEN x = 'cc' AND y = 'by' THEN 'cc-by' WHEN x = 'general' AND y = 'public' AND z = 'license' THEN 'gpl' WHEN x = 'all' AND y = 'rights' AND z = 'reserved' THEN 'reserved' END AS label FROM n)
    SELECT d.doc_id, any_value(len(w))::BIGINT AS n_words, count(label) AS n_base, min(i) FILTER (label IS NOT NULL) AS first_word, max(i) FILTER (label IS NOT NULL) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
    FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""

SECRET_SQL = r"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

SHARD_SQL = """SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS bytes, 24::BIGINT AS shards, count(*) AS places FROM documents"""


def queries() -> dict:
    made = (op1_toxicity, op2_kd_shards, op3_simhash, op4_quality_rules, op5_token_files, op6_packing, op7_license_scan, op8_secrets, op9_importance_resampling, op10_decontamination)
    return {f.__name__: f for f in (*made, quality_base, license_base, secret_base, shard_sizes)}


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express; the rest is tested by brute force."""
    return {"quality_base": QUALITY_SQL, "license_base": LICENSE_SQL, "secret_base": SECRET_SQL, "shard_sizes": SHARD_SQL}
