"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import bpe, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, secret_scan, suffix_dedup, toxicity
from hazardlens.llm.io import Stash, table


#: The vocabulary of op1 and of the pipeline's last stage.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.groups(table(spark, sf_dir, "documents"), Stash(spark, "op2"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Stash(spark, "op3"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), Stash(spark, "op5"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_groups(table(spark, sf_dir, "documents"), Stash(spark, "op6"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), Stash(spark, "op7"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), Stash(spark, "op8"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), Stash(spark, "op9"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeats(table(spark, sf_dir, "documents"), Stash(spark, "op10"), short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_jaccard_join, op3_source_mixing, op4_toxicity, op5_quality_rules, op6_exact_dedup, op7_suffix_dedup, op8_secret_scan, op9_personal_data, op10_line_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": mixing.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
}
