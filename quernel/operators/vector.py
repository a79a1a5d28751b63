"""Cosine search over a vector column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.exprs import cosine


def vector_search(table: DataFrame, key: str, vector: str, query: Sequence[float], threshold: float, limit: int = 100, score: str = "score") -> DataFrame:
    """key, score of the ``limit`` best rows at or above a threshold, best first, ties by key.

    Zero vectors and vectors of another length match nothing.  Each task keeps ``limit`` rows.
    """
    scored = table.select(F.col(key), cosine(vector, query).alias(score))
    return scored.where(F.col(score) >= threshold).orderBy(F.col(score).desc(), key).limit(limit)


def vector_matches(table: DataFrame, key: str, vector: str, query: Sequence[float], threshold: float, limit: int = 100) -> DataFrame:
    """The rows among the best matches, as a predicate would select them."""
    found = vector_search(table, key, vector, query, threshold, limit, "__score").select(F.col(key).alias("__key"))
    return table.join(found, F.col(key) == F.col("__key"), "left_semi")
