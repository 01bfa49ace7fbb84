"""One query for each operator of this subpackage, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chosen_path, exact_dedup, importance, language_id, mixing, pack_bfd, pack_histogram, phrase_dedup, pu_quality, sharding, url_rules, weighted_sampling
from .common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_bfd.digest(pack_bfd.pack_sequences(documents(spark, sf_dir)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_histogram.pack(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeats(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.neighbours(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_files(rules))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    every = (op1_exact_dedup, op2_token_ids, op3_mixing, op4_packing, op5_language_id, op6_jaccard_join, op7_quality, op8_phrase_dedup, op9_sharding, op10_fingerprints, op11_alignment, op12_url_rules, op13_importance, pipeline)
    return {f.__name__: f for f in every}


OP1_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_mixing": mixing.oracle(), "op12_url_rules": url_rules.ORACLE, "op13_importance": importance.ORACLE}
