"""Near copies by wide SimHash fingerprints and soft-decoded Golay keys.

Where op8's rule (4 of 64 bits) reaches only nearly identical texts, this one is made for texts that share about
two thirds of their shingles and more: five words a shingle, 256 bits a fingerprint, and two fingerprints link if they
differ in at most MAX_BITS bits.  A bit differs with probability angle / pi, so 52 bits are a cosine similarity of 0.8
of the shingle sets (a Jaccard similarity of 2/3); the bound leaves half a standard error more.

No set of keys can promise to find that many errors, so candidates come from soft decoding.  Each of the
fingerprint's 11 segments of 23 bits is decoded to the LIST codewords of the Golay code that correlate best with the
bits' margins (how far each count is from half), not with the bits alone: a bit near half, which is
what an edit flips, hardly counts.  A key is a pair of segments with a codeword of each; of the
55 * LIST**2 keys the KEYS with the highest sum of correlations are kept.  Pairs that share a key are verified on all
256 bits and joined into a forest, as in simhash.

The keys of linked texts meet with a probability that rises with their similarity; the README has the measured recall.
Two texts with equal fingerprints always meet.

Defined cases: a null or empty text has fingerprint zero and is a copy of any other such text; a text of fewer words than
a shingle is one shingle; of repeated rows and of rows that share an id the first stays; rows without an id
stand after all others of their group; an empty table gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import forget, lean, spread, tidy, written
from quernel.llm.components import components, thinned
from quernel.llm.simhash import bit_counts, golay, group_ids, linker, majority

SHINGLE_WORDS = 5
WIDTH = 4
MAX_BITS = 56
SEGMENT = 23
SEGMENTS = 64 * WIDTH // SEGMENT
LIST = 3
KEYS = 64
_CODE: list[np.ndarray] = []
_WORDS = [f"p{i}" for i in range(WIDTH)]
_PRINT = ", ".join(f"{w} long" for w in _WORDS)


def codewords() -> np.ndarray:
    """All codewords of the Golay code as rows of +1 / -1; a row's number is the codeword's data bits."""
    if not _CODE:
        data = np.arange(4096, dtype=np.int64) << 11
        code = golay()
        parity = code.low[data & 0xFFF] ^ code.high[data >> 12]
        _CODE.append((((data ^ parity)[:, None] >> np.arange(SEGMENT) & 1) * 2 - 1).astype(np.float32))
    return _CODE[0]


def margins(size: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How far each bit's count is from half, in steps of a 127th of the greatest."""
    apart = (2 * total - size[:, None]).astype(np.float64)
    return np.round(apart * (127 / np.maximum(np.abs(apart).max(axis=1, initial=0), 1))[:, None]).astype(np.int8)


def soft_keys(soft: np.ndarray, keys: int = KEYS, choices: int = LIST) -> np.ndarray:
    """The keys of each row of margins: (first segment, second segment, codeword, codeword) in one number."""
    n = len(soft)
    fit = soft[:, : SEGMENT * SEGMENTS].reshape(-1, SEGMENT).astype(np.float32) @ codewords().T
    row = np.arange(len(fit))
    best, score = np.empty((len(fit), choices), dtype=np.int64), np.empty((len(fit), choices), dtype=np.float32)
    for i in range(choices):
        best[:, i] = fit.argmax(axis=1)
        score[:, i] = fit[row, best[:, i]]
        fit[row, best[:, i]] = -np.inf
    best, score = best.reshape(n, SEGMENTS, choices), score.reshape(n, SEGMENTS, choices)
    a, b = np.triu_indices(SEGMENTS, 1)
    worth = (score[:, a, :, None] + score[:, b, None, :]).reshape(n, -1)
    pair = np.arange(len(a), dtype=np.int64)[None, :, None, None] << 24
    names = (pair | best[:, a, :, None] << 12 | best[:, b, None, :]).reshape(n, -1)
    chosen = np.argsort(-worth, axis=1, kind="stable")[:, :keys]
    return np.take_along_axis(names, chosen, axis=1)


def vertex(prints: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits that stand for a fingerprint of several words."""
    out = np.full(len(prints), np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64)))
    for word in prints.T:
        out = (out ^ word) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(w).to_numpy() for w in _WORDS]).view(np.uint64)


def _wide_prints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, total = bit_counts((t.as_py() for t in batch.column(batch.num_columns - 1)), shingle_words, WIDTH)
            prints, soft = majority(size, total).view(np.int64), margins(size, total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(prints[:, i]) for i in range(WIDTH)], pa.array([m.tobytes() for m in soft], pa.binary())], names=[*batch.schema.names[:-1], *_WORDS, "soft"])

    return run


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            soft = np.frombuffer(b"".join(part.column("soft").to_pylist()), dtype=np.int8).reshape(part.num_rows, 64 * WIDTH)
            found = soft_keys(soft)
            prints = np.repeat(_words(part).view(np.int64), found.shape[1], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *[pa.array(prints[:, i]) for i in range(WIDTH)]], names=["key", *_WORDS])


def _vertices(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(vertex(_words(batch), seed)), *batch.columns], names=["vertex", *batch.schema.names])

    return run


def _distinct(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, int]:
    """A row for each fingerprint with a number that no other has, and the seed of those numbers."""
    for seed in itertools.count():
        one = rows.groupBy(*_WORDS).agg(F.min("__id").alias("least"), F.min("soft").alias("soft"))
        named = written(spark, one.mapInArrow(lean(_vertices(seed)), f"vertex long, {_PRINT}, least long, soft binary"), "distinct")
        if named.select("vertex").distinct().count() == named.count():
            return named, seed
        forget(spark, named)  # two fingerprints of one number: about n * n / 2**65 of the time


def similar_rows(docs: DataFrame, id_column: str, row: str, text: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """__row, __id, component_id (the least id of the group; null if none has one), __group (a number of the group) and the
    fingerprint of every row."""
    spark = docs.sparkSession
    prints = docs.select(F.col(id_column).cast("long").alias("__id"), F.col(row).alias("__row"), F.col(text).alias("__text")).mapInArrow(lean(_wide_prints(shingle_words)), f"__id long, __row struct<f:bigint,i:bigint>, {_PRINT}, soft binary")
    rows = written(spark, prints, "prints")
    distinct, seed = _distinct(spark, rows)
    tidy(spark)
    # each row becomes KEYS, so the rows are dealt out for what they become, not for what they are
    keyed = distinct.select(*_WORDS, "soft").repartition(spread(spark), *_WORDS).mapInArrow(lean(_key_rows), f"key long, {_PRINT}").repartition("key").sortWithinPartitions("key", *_WORDS)
    find = linker(max_bits, lambda p: vertex(p, seed))
    links = components(keyed.mapInArrow(lean(lambda batches: thinned(find(batches))), "a long, b long"), stars=True)
    tidy(spark)
    groups = group_ids(spark, distinct.select("vertex", "least"), links)
    known = distinct.select("vertex", *[F.col(w).alias(f"__{w}") for w in _WORDS], "least")
    by_print = known.join(groups.withColumnRenamed("vertex", "__v"), F.col("vertex") == F.col("__v"), "left")
    by_print = written(spark, by_print.select(*[f"__{w}" for w in _WORDS], F.coalesce("component", "vertex").alias("__group"), F.when(F.col("__v").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "groups")
    same = [F.col(w) == F.col(f"__{w}") for w in _WORDS]
    return rows.drop("soft").join(by_print, same).select("__row", "__id", "component_id", "__group", *_WORDS)


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a column that names each row, the same whenever it is read: for a table of files its file and place there, so
    that it need not be copied; for anything else, numbers in a written table."""
    try:
        if "_metadata" not in docs.columns:
            return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias(row))
    except AnalysisException:
        pass  # not a table of files
    return written(docs.sparkSession, docs.withColumn(row, F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i"))), "numbered")


def kept_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """One document of each group: the first row of its least id."""
    row = f"__row_{uuid.uuid4().hex}"  # no column of the caller's
    numbered = _numbered(docs, row)
    found = similar_rows(numbered, id_column, row, **options)
    # of rows that share the least id, the first
    least = found.where(F.col("__id").eqNullSafe(F.col("component_id"))).groupBy("__group").agg(F.min("__row").alias("__least"))
    return numbered.join(least.select("__least"), F.col(row) == F.col("__least"), "left_semi").select(*docs.columns)
