"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import embedding_dedup, language_id, license_scan, mixing, packing, quality, simhash, suffix_dedup, vector_search, warc
from quernel.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_top_k": lambda s, d: vector_search.op1_top_k(table(s, d, "embeddings")),
        "op2_embedding_dedup": lambda s, d: embedding_dedup.op2_embedding_dedup(table(s, d, "embeddings")),
        "op3_language_id": lambda s, d: language_id.op3_language_id(table(s, d, "documents")),
        "op4_warc": lambda s, d: warc.op4_warc(table(s, d, "pages")),
        "op5_license_scan": lambda s, d: license_scan.op5_license_scan(table(s, d, "documents")),
        "op6_suffix_dedup": lambda s, d: suffix_dedup.op6_suffix_dedup(table(s, d, "documents")),
        "op7_mixing": lambda s, d: mixing.op7_mixing(table(s, d, "documents")),
        "op8_simhash": lambda s, d: simhash.op8_simhash(table(s, d, "documents")),
        "op9_quality": lambda s, d: quality.op9_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op10_packing": lambda s, d: packing.op10_packing(table(s, d, "documents")),
        "license_variants": lambda s, d: license_scan.variants(s),
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator; the others are tested against brute force in tests/llm."""
    return {
        "op1_top_k": vector_search.ORACLE,
        "op2_embedding_dedup": embedding_dedup.ORACLE,
        "op4_warc": warc.ORACLE,
        "op5_license_scan": license_scan.oracle(),
        "op6_suffix_dedup": suffix_dedup.ORACLE,
        "license_variants": license_scan.variants_oracle(),
    }
