"""The corpus pipeline: toxicity, line dedup, near-duplicate join, source mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from hazardlens.llm.exprs import spare
from hazardlens.llm.io import Stash, table
from hazardlens.llm.queries import RANKS


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted toxic.

    Null texts score as empty ones; repeated rows score alike; without labels of both classes everything stays. Empty
    table: empty result. Other columns stay as they are, whatever their names.
    """
    return toxicity.ordinary_only(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are similar to an earlier one; every document stays, also if no line does.

    Null texts stay null. ``n_chars``, where there is such a column, is counted anew for texts that lost lines. Whole rows
    that repeat count as one occurrence. Empty table: empty result. Other columns stay as they are, whatever their names.
    """
    lines, removed = spare(docs, "n_lines", "n_removed")
    out = line_dedup.without_repeats(docs, Stash(spark, "lines"), short=True, counts=(lines, removed))
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    size = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Null ids count as the largest; texts without words all stay; whole rows that repeat are copies. Empty table: empty
    result. Other columns stay as they are, whatever their names.
    """
    return jaccard_join.one_of_each(docs, Stash(spark, "groups"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: rows repeat, or go where a source has more than its target.

    The one document a source whose repetition is a fraction of its words counts whole from half of them on. Texts without
    words stay once; a null source is a source; rows are told apart by all their columns. Empty table: empty result.
    """
    return mixing.mixed_rows(docs, Stash(spark, "mix"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of the mix; a null text has no ids. Empty table: empty result."""
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Compression, set joins and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and reread as the next one's input."""
    stash = Stash(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
