"""A training corpus from `documents`: language, near copies, repeated passages, mixture, windows.

Each stage works on all that the one before it kept, which it reads back from Parquet.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import language_id, mixing, near_copies, packing, suffix_dedup
from quernel.llm.common import table, tidy, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the rest of them teaches; those without a letter or between languages go."""
    tidy(spark)
    found = language_id.language_id(docs, language_id.fit(docs))
    return found.where(~language_id.rejected(F.col("lang_pred"), F.col("lang_ambiguous"), F.col("text"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id."""
    tidy(spark)
    return near_copies.kept_documents(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in an earlier document or earlier in their own."""
    tidy(spark)
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source weights: documents whole, in selected blocks, repeated, or not at all."""
    tidy(spark)
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 ids."""
    tidy(spark)
    return packing.op10_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can express neither the classifier nor the fingerprints; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
