"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fim, hard_negatives, html_text, language_id, license_scan, mixing, ngram_join, packing, pii, quality, sharding, token_rollup

#: Weights of the query for mixing.
MIX = mixing.Mix()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"))


def op3_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(_table(spark, sf_dir, "documents"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.rollup(_table(spark, sf_dir, "documents"))


def op5_byte_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"))


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), MIX)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan,
            op2_ngram_jaccard_join,
            op3_language_identification,
            op4_token_rollups,
            op5_byte_balanced_sharding,
            op6_quality_outliers,
            op7_benchmark_decontamination,
            op8_html_text,
            op9_source_mixing,
            op10_personal_data,
            op11_best_fit_packing,
            op12_fill_in_middle,
            op13_hard_negatives,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_join.GROUPS_SQL,
        "op4_token_rollups": token_rollup.ROLLUP_SQL,
        "op5_byte_balanced_sharding": sharding.SHARD_SQL,
        "op7_benchmark_decontamination": decontaminate.CONTAMINATION_SQL,
        "op9_source_mixing": mixing.mixture_sql(MIX),
        "op12_fill_in_middle": fim.TRANSFORMED_SQL,
        "op13_hard_negatives": hard_negatives.HARD_NEGATIVES_SQL,
    }
