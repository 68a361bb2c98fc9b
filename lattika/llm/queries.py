"""The queries of this subpackage, and their SQL where it has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicate_join

    return near_duplicate_join(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_documents(spark, sf_dir))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digest

    return secret_digest(_documents(spark, sf_dir))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_documents

    return scan_documents(_documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scoring import score

    return score(_documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_files

    return token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_digest

    return shard_digest(_documents(spark, sf_dir), 16)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import manifest_digest

    return manifest_digest(_documents(spark, sf_dir))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can express."""
    from .quality import judge

    return judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def scoring_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express, rounded."""
    from .scoring import base_scores

    return base_scores(_documents(spark, sf_dir)).withColumn("base_score", F.round("base_score", 6))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can express, rounded."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


PARTS = (quality_base, scoring_base, mixing_targets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_ngram_jaccard_join, op3_language_id, op4_secret_scans, op5_license_scans, op6_lm_scoring, op7_mixing, op8_token_files, op9_sharding, op10_decontamination, op11_packing, op12_importance_resampling, op13_merkle_manifest, *PARTS)}


def oracle_sql() -> dict[str, str]:
    from .manifest import digest_sql as manifest_sql
    from .mixing import targets_sql
    from .near_duplicates import join_sql
    from .quality import base_sql as quality_sql
    from .resampling import resample_sql
    from .scoring import base_sql as scoring_sql
    from .secrets import digest_sql
    from .sharding import digest_sql as shards_sql

    own = {"op2_ngram_jaccard_join": join_sql(), "op4_secret_scans": digest_sql(), "op9_sharding": shards_sql(), "op12_importance_resampling": resample_sql(), "op13_merkle_manifest": manifest_sql()}
    return own | {"quality_base": quality_sql(), "scoring_base": scoring_sql(), "mixing_targets": targets_sql()}
