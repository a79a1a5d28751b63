"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL-proximal updates.

A text is the multiset of its word n-grams (see ngrams.word_ngrams) in 2**FEATURE_BITS slots, each
weighing its share of the text; the score is the logistic of a sparse dot product.

Fitting reads a bounded sample of labelled rows (SAMPLE_ROWS, the first in a seeded order) and takes one
executor task, which sees each row once an epoch.  Scoring reads every whole text, in pieces of about 4 Mi characters
that end with a word; no n-gram spans two pieces.

Defined cases: a null or empty text has no n-gram and gets the score of the bias alone; ids whose labels
contradict each other are not learned from; null labels or ids neither; of documents that share an id one is learned
from; without any label all scores are 0.5; repeated rows are scored alike; other columns are not read, but for those that
are carried, whose names may clash with none but the one that is added, which replaces it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import held_out, lean
from quernel.llm.ngrams import word_ngrams

SAMPLE_ROWS = 6000
FEATURE_BITS = 18
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0005, 0.001
CUT = 0.3
SEED = 3
SCALE = 20.0
_PIECE = 1 << 22
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def _pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    """The text in pieces of at least ``size`` characters that end with a word; a word of more than twice that is cut."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = _SPACE.search(text, end, end + size)
            end = found.start() if found else end + size
        yield text[at:end]
        at = end


def features(text: str | None, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their values."""
    parts = [word_ngrams(piece.encode("utf-8", "replace"), bits) for piece in _pieces(text or "")]
    slots = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
    return slots, np.full(len(slots), SCALE / max(len(slots), 1), dtype=np.float64)


class Ftrl:
    """FTRL-proximal for logistic loss; the last slot is the bias."""

    def __init__(self, slots: int):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _trainer(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Ftrl(1 << bits), []
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                slots, value = features(text.as_py(), bits)
                at, count = np.unique(slots, return_counts=True)
                rows.append((np.append(at, 1 << bits).astype(np.int32), np.append(count * (value[0] if len(value) else 0), 1.0).astype(np.float32), label))
        for _ in range(epochs):
            for at, value, label in rows:
                model.learn(at, value.astype(np.float64), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype(np.float32).tobytes()])], names=["weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, bits: int = FEATURE_BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all slots and the bias."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    each = known.groupBy(F.col("doc_id").alias("__id")).agg(F.min(label).alias("label"), F.max(label).alias("__most")).where("label = __most").drop("__most")
    sample = each.orderBy(F.xxhash64(F.lit(SEED), "__id"), "__id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    # one row for each id, however many share it; so the number of rows is bounded: one task
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")
    rows = rows.groupBy("doc_id").agg(one).select("doc_id", "r.text", "r.label")
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id", F.xxhash64("text"))
    found = ordered.mapInArrow(lean(_trainer(bits, epochs)), "weights binary").toArrow().column("weights").to_pylist()
    return np.frombuffer(found[0], dtype=np.float32) if found else np.zeros((1 << bits) + 1, dtype=np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns of it in carry) with quality_score."""
    names = [c for c in (docs.columns if carry is None else carry) if c != "quality_score"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "quality_score double"])
    bits = int(np.log2(len(weights) - 1))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(len(names))):
                slots, value = features(t.as_py(), bits)
                scores[i] = float(w[-1]) + (float(w[slots].sum(dtype=np.float64)) * value[0] if len(slots) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(1 / (1 + np.exp(-np.clip(scores, -35, 35))))], names=[*names, "quality_score"])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(lean(run), schema)


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = score_quality(docs, fit(docs, labels), carry=["doc_id"])
    score = F.col("quality_score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
