"""Connected components of a table of links, by alternating large and small stars.

Each half-round gives every vertex the least vertex of its neighbourhood and hangs the neighbours
there.  Minima are aggregated map-side and joined back, those of vertices with very many links by
broadcast; rounds grow with the logarithm of the diameter.  Every round is a written table in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import forget, lean, written

MAX_ROUNDS = 64
#: A vertex is hot beyond MIN_HOT links and one in MAX_HOT of all.
MIN_HOT, MAX_HOT = 100, 5000


class Forest:
    """Union-find over arbitrary integers; the least member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, top = self.parent, x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch's links, as stars."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        below = np.array(list(forest.parent), dtype=np.int64)
        roots = np.array([forest.root(x) for x in below.tolist()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(below), pa.array(roots)], names=["a", "b"])


def _with_least(edges: DataFrame, end: str, least: DataFrame, count: int) -> DataFrame:
    """edges with ``m``, the least vertex (k, m, n) around their vertex at one end.

    A vertex with more than ``hot`` of the links is looked up in a broadcast table, which those bounds keep to
    2 * MAX_HOT rows; the others are few enough for a task each.
    """
    hot = max(MIN_HOT, count // MAX_HOT)
    known = F.broadcast(least.where(F.col("n") > hot).select(F.col("k").alias("hk"), F.col("m").alias("hm")))
    looked = edges.join(known, F.col(end) == F.col("hk"), "left")
    found = looked.where("hk IS NOT NULL").select("a", "b", F.col("hm").alias("m"))
    rest = looked.where("hk IS NULL").select("a", "b").join(least.where(F.col("n") <= hot), F.col(end) == F.col("k")).select("a", "b", "m")
    return found.unionByName(rest)


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """edges: a > b.  Large: neighbours above a vertex hang on the least of its neighbourhood; small: those below."""
    if large:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "n")
        # every edge a > b is seen from b: a hangs on the least neighbour of b
        moved = _with_least(edges, "b", least, count).select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("k"), "m", "n")
        moved = _with_least(edges, "a", least, count).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return moved.distinct()


def components(edges: DataFrame, stars: bool = False) -> DataFrame:
    """id, component (the least id reachable) of every vertex that has a link.  edges: two long columns; loops
    and repeats are allowed, null ends are not links.  stars: the edges went through thinned() already."""
    spark = edges.sparkSession
    a, b = edges.columns
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = written(spark, (links if stars else links.mapInArrow(lean(thinned), "a long, b long")).distinct(), "links")
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = digest(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        then = written(spark, _star(_star(now, True, mark[0]), False, mark[0]), "links")
        forget(spark, now)
        now, before, mark = then, mark, digest(then)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    hung = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return hung.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
