"""Language identification with error-correcting output codes.

Languages get codewords of BITS bits whose least pairwise distance is as large as a seeded search finds.  A
linear classifier over hashed byte n-grams of the whole lower-cased text predicts each bit (ridge
regression on +1 / -1 in its dual form).  Decoding is loss-weighted: the language whose codeword has the
least sum of logistic losses over the bits' margins wins, and the text is ambiguous if the runner-up is nearly
as near.

Fitting reads a bounded sample: at most SAMPLE_ROWS labelled rows, equally many of each language, the first in
a seeded order.  Scoring reads every whole text, in pieces of bounded size, so that a very long text
is not copied whole.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not ambiguous; null lang
rows are not learned from; of rows that share an id (all null ids are one) one is learned from; with no labelled
row at all, every text is ``und``; repeated rows are scored alike; other columns are not read, but for those that are
carried, whose names may clash with none but the three that are added, which replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import held_out, lean, trim
from quernel.llm.ngrams import byte_ngrams

SAMPLE_ROWS = 2400
FEATURE_BITS = 12
SIZES = (1, 2, 3, 4)
BITS = 15
RIDGE = 0.03
SHARPNESS = 4.0
AMBIGUOUS_MARGIN = 0.05
UNDETERMINED = "und"
MIXED_CHARS = 100
SEED = 5
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 22
#: Rows of the products of all profiles that are worked out together.
_BLOCK = 256


def codewords(count: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """count distinct rows of +1 / -1, far apart: of seeded random candidates the farthest from those chosen."""
    while 2 ** (bits - 1) < count:
        bits += 4
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2, size=(max(4096, 8 * count), bits)) * 2 - 1, axis=0)
    rng.shuffle(pool)
    chosen, least = [0], np.full(len(pool), bits + 1)
    while len(chosen) < count:
        least = np.minimum(least, (pool != pool[chosen[-1]]).sum(axis=1))
        chosen.append(int(least.argmax()))
    return pool[chosen].astype(np.float64)


def features(text: str | None, bits: int = FEATURE_BITS) -> np.ndarray | None:
    """The text's n-gram profile of length 1; None if it is null or has no letter."""
    if text is None or not _LETTER.search(text):
        return None
    counts = np.zeros(1 << bits)
    for at in range(0, len(text), _PIECE):
        # pieces overlap by the n-grams that cross the cut
        piece = text[at : at + _PIECE + max(SIZES) - 1].lower().encode("utf-8", "replace")
        counts += np.bincount(byte_ngrams(piece, SIZES, bits), minlength=1 << bits)
    profile = np.sqrt(counts)
    return profile / np.linalg.norm(profile)


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray):
        self.languages, self.code, self.weights = languages, code, weights

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, score and ambiguity of the nearest codeword for rows of bit margins."""
        agree = margins[:, None, :] * self.code[None, :, :]
        loss = np.logaddexp(0, -SHARPNESS * agree).sum(axis=2)
        order = np.sort(loss, axis=1)
        best = loss.argmin(axis=1)
        belief = np.exp(-(loss - order[:, :1]))
        score = 1 / belief.sum(axis=1)
        gap = (order[:, 1] - order[:, 0]) / (SHARPNESS * self.code.shape[1]) if loss.shape[1] > 1 else np.ones(len(loss))
        return best, score, gap < AMBIGUOUS_MARGIN


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = FEATURE_BITS) -> Model | None:
    """Learn from text and lang of rows that are not held out; None if there are none."""
    keep = lambda df: df.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    # ids, not rows: a few may have most rows
    sizes = keep(docs.select("doc_id", "lang")).groupBy("lang").agg((F.approx_count_distinct("doc_id") + 1).alias("n"))
    counts = {r.lang: r.n for r in sizes.orderBy(F.col("n").desc(), "lang").limit(sample_rows).collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    # About twice as many of each language as are wanted, by the key; the first of them are the sample.
    share = docs.sparkSession.createDataFrame([(k, min(1.0, (2 * each + 64) / n)) for k, n in counts.items()], "__lang string, __share double")
    # Ids first, then their texts.
    key = F.xxhash64(F.lit(SEED), "doc_id")
    first = Window.partitionBy("lang").orderBy("__key", F.col("doc_id").asc_nulls_last())
    drawn = F.pmod(F.col("__key"), F.lit(1 << 30)) < F.col("__share") * (1 << 30)
    near = keep(docs.select("doc_id", "lang")).withColumn("__key", key).join(F.broadcast(share), F.col("lang") == F.col("__lang")).where(drawn)
    # An id that very many rows share, the null one among them, is one id here and one row below.
    ids = near.select("doc_id", "lang", "__key").distinct().withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= each).select(F.col("doc_id").alias("__id")).distinct()
    rows = keep(docs.select("doc_id", "lang", "text")).join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("__id")))
    one = F.min(F.struct(F.xxhash64("text", "lang").alias("h"), "text", "lang")).alias("r")
    rows = rows.groupBy("doc_id").agg(one).select("r.text", "r.lang")

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, p.astype(np.float32).tobytes()) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (p := features(text, bits)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["lang", "profile"])

    sample = rows.mapInArrow(lean(profiles), "lang string, profile binary").toArrow()
    if not sample.num_rows:
        return None
    lang = sample.column("lang").to_pylist()
    x = np.empty((sample.num_rows, 1 << bits), dtype=np.float32)
    for i, profile in enumerate(sample.column("profile")):
        x[i] = np.frombuffer(profile.as_buffer(), dtype=np.float32)
    del sample, profile  # the driver has little room
    trim()
    order = np.lexsort((x @ np.arange(1, x.shape[1] + 1, dtype=np.float32), np.array(lang)))  # the same fit however rows arrive
    x, lang = x[order], [lang[i] for i in order]
    languages = sorted(set(lang))
    code = codewords(len(languages))
    weights = _ridge(x, code[[languages.index(v) for v in lang]])
    trim()
    return Model(languages, code, weights)


def _ridge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the ridge regression of y on the rows of x, in its dual form."""
    gram = np.empty((len(x), len(x)))
    for at in range(0, len(x), _BLOCK):
        gram[at : at + _BLOCK] = x[at : at + _BLOCK] @ x.T
    gram.flat[:: len(gram) + 1] += RIDGE
    return (x.T @ np.linalg.solve(gram, y).astype(np.float32)).astype(np.float64)


def language_id(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns of it in carry) with lang_pred, lang_score and lang_ambiguous."""
    added = ["lang_pred", "lang_score", "lang_ambiguous"]
    names = [c for c in (docs.columns if carry is None else carry) if c not in added]
    # the text crosses to Python once
    columns = [*names, *([] if text in names else [text])]
    at_text = columns.index(text)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "lang_pred string", "lang_score double", "lang_ambiguous boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                profiles = [features(t.as_py()) if model else None for t in part.column(at_text)]
                pred, score, unsure = [UNDETERMINED] * len(profiles), np.zeros(len(profiles)), np.zeros(len(profiles), dtype=bool)
                known = [i for i, p in enumerate(profiles) if p is not None]
                if known:
                    best, s, a = model.decode(np.stack([profiles[i] for i in known]) @ model.weights)
                    score[known], unsure[known] = s, a
                    for i, b in zip(known, best, strict=True):
                        pred[i] = model.languages[b]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], names=[*names, *added])

    return docs.select(*columns).mapInArrow(lean(run), schema)


def op3_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    found = language_id(docs, fit(docs), carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def rejected(pred: Column, ambiguous: Column, text: Column) -> Column:
    """What the pipeline drops: texts without a letter, and those between languages.  A text of less than MIXED_CHARS
    may be ambiguous for want of evidence only; it stays."""
    return (pred == UNDETERMINED) | (ambiguous & (F.length(text) >= MIXED_CHARS))
