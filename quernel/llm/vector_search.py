"""Exact top-k search by inner product with vector-approximation files.

Rows are dealt by hash into groups of bounded size.  A group's vectors are quantised per dimension
into 2**bits cells; the cells alone bound every score from both sides.  For a query, the kth largest
lower bound rules out most rows; the rest are read exactly in order of falling upper bound until
the kth score found is above every bound left.  Queries are dealt to every group and stream through in
blocks, so a task holds one group and one block, whatever the table's size.

Scores are integer: a component x becomes floor(scale * x).  Products are exact: float64 while no
sum can pass 2**53, Python integers beyond.  The bounds need no more than single precision, with the
rounding that it may cause added to them, so they cost half of what exact scores of all rows would.

Defined cases: vectors that are null, empty or hold null or non-finite components (also once they are scaled), and rows
without an id, take no part; vectors of different length are not compared; rows that share the query's id are
its own; an id that repeats counts once for a query, with its best score; a score that a long cannot hold is the greatest
or the least long in the table returned, and ranks as such there (a file's own search has it exactly); an empty table gives an empty result; only the id and the vector are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import lean

from quernel.llm.vectors import by_length

SCALE = 256.0
BITS = 6
#: Rows of a group at most, and at least where there are tasks to spare: queries meet every group, so fewer are better.
GROUP_ROWS = 32_768
LEAST_GROUP_ROWS = 1024
QUERY_BLOCK = 64
CHUNK = 64
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1


class ApproximationFile:
    """The quantised cells of a group's vectors, beside the exact ones."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], exact[order]
        self.low = self.exact.min(axis=0)
        self.largest = float(np.abs(self.exact).max())
        self.bounded = self.largest < 1e100  # beyond, sums of products may not be finite
        if self.bounded:
            self.width = np.maximum(np.ceil((self.exact.max(axis=0) - self.low + 1) / 2**bits), 1)
            self.cells = np.floor((self.exact - self.low) / self.width).astype(np.uint8 if bits <= 8 else np.uint16)
            self.most = self.cells.max(axis=0).astype(np.float64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, from the cells only."""
        if not self.bounded or np.abs(queries).max() >= 1e100:
            none = np.full((len(queries), len(self.ids)), np.inf)
            return -none, none
        half = (self.width - 1) / 2
        scaled = queries * self.width
        greatest = (np.abs(scaled) @ self.most)[:, None]
        kind, unit = (np.float32, 2.0**-23) if greatest.max(initial=0) < 1e30 else (np.float64, 2.0**-52)
        middle = (scaled.astype(kind) @ self.cells.T.astype(kind)).astype(np.float64) + (queries @ (self.low + half))[:, None]
        reach = (np.abs(queries) @ half)[:, None]
        # a sum of n rounded products of rounded factors is off by less than (n + 3) units of the sum of their sizes
        slack = (queries.shape[1] + 3) * unit * greatest + 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle - reach - slack, middle + reach + slack

    def scores(self, rows: np.ndarray, query: np.ndarray, as_long: bool = False) -> np.ndarray:
        """Exact scores: longs, or Python's integers if one of them is beyond a long; as_long: those are the greatest or the
        least long."""
        if self.largest * float(np.abs(query).max()) * len(query) < 2**53:
            return (self.exact[rows] @ query).astype(np.int64)
        whole = [int(x) for x in query]
        found = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in self.exact[rows]]
        if as_long:
            found = [min(max(x, _LEAST), _GREATEST) for x in found]
        return np.array(found, dtype=np.int64 if all(_LEAST <= x <= _GREATEST for x in found) else object)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, as_long: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of each query's best k ids here, each by its best row, ties to smaller ids.  as_long: a score
        that a long cannot hold ranks as the greatest or the least that it can."""
        lower, upper = self.bounds(queries)
        if as_long:
            lower, upper = (np.clip(b, -(2.0**63), 2.0**63) for b in (lower, upper))
        firsts = np.flatnonzero(np.concatenate([[True], self.ids[1:] != self.ids[:-1]]))  # of each id's rows
        for q in range(len(ids)):
            own = self.ids == ids[q]
            up = upper[q]
            others = len(firsts) - int(own[firsts].sum())
            if not others:
                continue
            low = np.maximum.reduceat(np.where(own, -np.inf, lower[q]), firsts)
            kth = np.partition(low, -min(k, others))[-min(k, others)]
            rows = np.flatnonzero(~own & (up >= kth))
            rows = rows[np.argsort(-up[rows], kind="stable")]
            names, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            for at in range(0, len(rows), CHUNK):
                if len(best) == k and int(best[-1]) > up[rows[at]].item():  # Python compares the two exactly
                    break  # no row left can reach the kth score
                part = rows[at : at + CHUNK]
                names, best = np.concatenate([names, self.ids[part]]), np.concatenate([best, self.scores(part, queries[q], as_long)])
                order = _ranked(names, best)
                names, best = names[order], best[order]
                first = np.sort(np.unique(names, return_index=True)[1])[:k]  # an id's best row only
                names, best = names[first], best[first]
            yield int(ids[q]), names, best


def _ranked(names: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The order of falling scores, ties by rising names."""
    if scores.dtype != object:
        return np.lexsort((names, ~scores))  # ~x falls as x rises, the least long included
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], names[i])), dtype=np.int64)


def _searcher(k: int, scale: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, files = None, {}, {}
        out: list[tuple[int, np.ndarray, np.ndarray]] = []

        def close() -> None:
            for length, parts in held.items():
                files[length] = ApproximationFile(np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts]), bits)
            held.clear()

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for key in np.unique(keys):
                if key != group:
                    group = key
                    held.clear()
                    files.clear()
                mine = batch.filter(pa.array(keys == key))
                is_query = mine.column(1).to_numpy() == 1
                for wanted in (False, True):
                    part = mine.filter(pa.array(is_query == wanted))
                    if not part.num_rows:
                        continue
                    if wanted:
                        close()
                    ids = part.column(2).to_numpy()
                    for rows, matrix in by_length(part.column(3)):
                        with np.errstate(over="ignore"):
                            exact = np.floor(matrix * scale)
                        if not (good := np.isfinite(exact).all(axis=1)).all():
                            rows, matrix, exact = rows[good], matrix[good], exact[good]
                            if not len(rows):
                                continue
                        if not wanted:
                            held.setdefault(matrix.shape[1], []).append((ids[rows], exact))
                        elif matrix.shape[1] in files:
                            for at in range(0, len(rows), QUERY_BLOCK):
                                out += files[matrix.shape[1]].search(ids[rows[at : at + QUERY_BLOCK]], exact[at : at + QUERY_BLOCK], k, as_long=True)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64)), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))],
                    names=["query_id", "vec_id", "score"],
                )
                out.clear()

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_column: str = "vec_id",
    vector: str = "embedding",
    scale: float = SCALE,
    bits: int = BITS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best vectors, exactly."""
    named = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    count = vectors.count()
    groups = max(1, -(-count // group_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, count // LEAST_GROUP_ROWS))
    dealt = named(vectors).select(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(groups)).cast("long").alias("group"), F.lit(0).alias("kind"), "id", "vector")
    asked = named(queries).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(1).alias("kind"), "id", "vector")
    rows = dealt.unionByName(asked).repartition("group").sortWithinPartitions("group", "kind", "id")
    found = rows.mapInArrow(lean(_searcher(k, scale, bits)), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(vectors: DataFrame) -> DataFrame:
    """The 5 best of all other rows for every row whose vec_id is divisible by 50."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
