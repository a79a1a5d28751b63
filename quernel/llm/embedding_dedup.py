"""Embedding near-dedup: an exact metric range join with pivots.

On unit vectors cosine >= t is Euclidean distance <= r = sqrt(2 - 2t), a metric.  Within a label, each
vector has its home in the cell of the nearest pivot; a vector at distance d from its own pivot can
only be near a vector of another cell if that cell's pivot is within d + 2r (triangle inequality), and
is replicated to those cells.  So all links of a vector are found in its home cell, and cells join
independently.  Inside a cell

* members within r / 2 of the pivot are all linked to each other: they are counted, never paired, which
  takes care of a third of all rows being near copies of one vector;
* home rows are cut into chunks of about CHUNK_ROWS by their distance from the pivot (rings); a member at
  distance d is sent only to the chunks whose ring meets [d - r, d + r], and streams past them.

What is shuffled for a cell of n members is at most n * n / CHUNK_ROWS vectors, in the precision they came in.

Pivots come from a bounded sample (at most MAX_PIVOTS in all), which decides only how work is cut, never
what links.  A label without pivots is one cell, cut into chunks like any other.

Other columns than the three are not read, whatever their names.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing and stay (kept); vectors of different length do not link; rows that
share a vec_id are one vertex of the graph and each counts as a link of others; a null vec_id takes no part and is
not kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import lean, small, written
from quernel.llm.components import Forest, components
from quernel.llm.vectors import by_length

THRESHOLD = 0.98
CELL_ROWS = 16_384
MAX_PIVOTS = 4096
SAMPLE_PER_PIVOT = 8
CHUNK_ROWS = 16_384
#: Cosines that are held at once.
BLOCK = 1 << 21
SEED = 11
#: Distances this close to a bound are not decided by it.  A distance is sqrt(2 - 2 cosine), so where it is small, rounding of
#: n products moves it by up to sqrt(8 (n + 4) / 2**53): less than this below 100,000 dimensions.
SLACK = 1e-5
#: Rings are made of bins of this width.
BIN = 1 / 128


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, exactly, so that no square overflows or vanishes."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows that are not zero, at length 1."""
    level = scaled(matrix)
    return level / np.linalg.norm(level, axis=1, keepdims=True)


def _pivots(rows: DataFrame, cell_rows: int, max_pivots: int) -> dict[int, dict[int, np.ndarray]]:
    """label -> length of vector -> pivots, for labels of more than a cell's rows; from at most
    max_pivots * SAMPLE_PER_PIVOT rows, the first of each label in a seeded order."""
    large = rows.groupBy("label").count().where(F.col("count") > cell_rows).orderBy(F.col("count").desc(), "label").limit(max_pivots).collect()
    total = sum(r["count"] for r in large)
    wanted = {r["label"]: min(math.ceil(r["count"] / cell_rows), max(1, max_pivots * r["count"] // max(total, 1))) for r in large}
    out: dict[int, dict[int, np.ndarray]] = {}
    if not wanted:
        return out
    spark = rows.sparkSession
    quota = spark.createDataFrame([(k, v * SAMPLE_PER_PIVOT / n) for k, v, n in ((r["label"], wanted[r["label"]], r["count"]) for r in large)], "l int, share double")
    drawn = (F.pmod(F.xxhash64(F.lit(SEED), "rid"), F.lit(1 << 30)) / float(1 << 30)) < F.col("share")
    sample = rows.join(F.broadcast(quota), F.col("label") == F.col("l")).where(drawn).limit(2 * max_pivots * SAMPLE_PER_PIVOT).select("label", "vector").toArrow()
    for label in wanted:
        mine = sample.filter(pa.compute.equal(sample.column("label"), label))
        for _, matrix in by_length(mine.column("vector")):
            matrix = matrix[matrix.any(axis=1)]
            if not len(matrix):
                continue
            points = units(matrix)
            # farthest first, so that pivots spread and a dense group gets one
            chosen, far = [0], np.full(len(points), np.inf)
            while len(chosen) < min(wanted[label], len(points)):
                far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
                chosen.append(int(far.argmax()))
            out.setdefault(label, {})[matrix.shape[1]] = points[chosen]
    return out


def _assigner(pivots: dict[int, dict[int, np.ndarray]], radius: float):
    """rid, label, vector -> a row for each cell the vector is a member of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, label = batch.column("rid").to_numpy(), batch.column("label").to_numpy()
            source, cell, dist, home = [], [], [], []
            for rows, matrix in by_length(batch.column("vector")):
                some = matrix.any(axis=1)
                rows, points = rows[some], units(matrix[some])
                for one in np.unique(label[rows]):
                    mine = np.flatnonzero(label[rows] == one)
                    marks = pivots.get(int(one), {}).get(matrix.shape[1])
                    if marks is None:
                        source.append(rows[mine])
                        cell.append(np.zeros(len(mine), dtype=np.int32))
                        dist.append(np.full(len(mine), np.nan))
                        home.append(np.ones(len(mine), dtype=bool))
                        continue
                    d = np.sqrt(np.maximum(2 - 2 * points[mine] @ marks.T, 0))
                    own = d.argmin(axis=1)
                    member = d <= d.min(axis=1)[:, None] + 2 * radius + SLACK
                    at, to = np.nonzero(member)
                    source.append(rows[mine][at])
                    cell.append(to.astype(np.int32))
                    dist.append(d[at, to])
                    home.append(to == own[at])
            if source:
                source = np.concatenate(source)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[source]), batch.column("vec_id").take(pa.array(source)), pa.array(label[source]), pa.array(np.concatenate(cell)), pa.array(np.concatenate(dist), from_pandas=True), pa.array(np.concatenate(home)), batch.column("vector").take(pa.array(source))],
                    names=["rid", "vec_id", "label", "cell", "dist", "home", "vector"],
                )

    return run


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines reach the threshold; those too near it for the product's rounding are summed exactly."""
    cosine = units(left) @ units(right).T
    out = cosine >= threshold
    unsure = 8 * (left.shape[1] + 8) * 2.0**-53
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < unsure), strict=True):
        a, b = scaled(left[i : i + 1])[0], scaled(right[j : j + 1])[0]
        out[i, j] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= threshold
    return out


def _joiner(threshold: float, radius: float):
    """Rows sorted by (label, cell, chunk, kind): a chunk's home rows, then the cell's members -> a row
    (kind 0, rid, links) for each home row and rows (kind 1, vec_id, vec_id) that connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        held: list[tuple] = []  # of the chunk: rid, vec_id, dist, matrix, links by vector length
        out: list[tuple] = []

        def finish() -> None:
            for _, part in held:
                out.append((np.zeros(len(part["rid"]), dtype=np.int32), part["rid"], part["links"]))
                if part["edges"]:
                    pairs = np.array(part["edges"], dtype=np.int64)
                    out.append((np.ones(len(pairs), dtype=np.int32), pairs[:, 0], pairs[:, 1]))
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["kind", "a", "b"])
                out.clear()

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "cell", "chunk", "kind")])
            cuts = np.flatnonzero(np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)]))
            for start, stop in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if key is None or not np.array_equal(keys[start, :3], key):
                    finish()
                    key = keys[start, :3].copy()
                part = batch.slice(start, stop - start)
                rid, ids = part.column("rid").to_numpy(), part.column("vec_id").to_numpy()
                dist = part.column("dist").to_numpy(zero_copy_only=False)
                for rows, matrix in by_length(part.column("vector")):
                    mine = {"rid": rid[rows], "ids": ids[rows], "dist": dist[rows], "core": dist[rows] <= radius / 2 - SLACK, "vectors": matrix}
                    if keys[start, 3] == 0:
                        mine |= {"links": np.zeros(len(rows), dtype=np.int64), "edges": [], "forest": Forest()}
                        held.append((matrix.shape[1], mine))
                        continue
                    for length, chunk in held:
                        if length == matrix.shape[1]:
                            meet(chunk, mine)
            yield from flush()
        finish()
        yield from flush()

    def meet(chunk: dict, member: dict) -> None:
        order = np.argsort(member["dist"], kind="stable")
        step = max(32, BLOCK // max(len(chunk["dist"]), 1))
        for at in range(0, len(order), step):
            sub = order[at : at + step]
            near = member["dist"][sub]
            lo, hi = near.min(), near.max()
            # |d(u, p) - d(v, p)| <= d(u, v); NaN (no pivot) rules nothing out
            rows = np.flatnonzero(~((chunk["dist"] < lo - radius - SLACK) | (chunk["dist"] > hi + radius + SLACK)))
            if chunk["core"].any() and member["core"][sub].all():
                rows = rows[~chunk["core"][rows]]
            if not len(rows):
                continue
            links = linked(chunk["vectors"][rows], member["vectors"][sub], threshold)
            # counted for the whole cell at once
            links &= ~(chunk["core"][rows][:, None] & member["core"][sub][None, :])
            links &= chunk["rid"][rows][:, None] != member["rid"][sub][None, :]
            chunk["links"][rows] += links.sum(axis=1)
            i, j = np.nonzero(links)
            forest, edges = chunk["forest"], chunk["edges"]
            for a, b in zip(chunk["ids"][rows[i]].tolist(), member["ids"][sub[j]].tolist(), strict=True):
                if forest.join(a, b):
                    edges.append((a, b))

    return run


def _bin(dist: Column) -> Column:
    return F.coalesce(F.floor(dist / BIN), F.lit(-1)).cast("int")


def _rings(members: DataFrame, chunk_rows: int) -> DataFrame:
    """label, cell, bins (bin of distances -> first and last chunk of its home rows), rings (chunk, lo, hi: the distances in it).

    Chunks take the cell's home rows in order of distance; a bin of more than a chunk's rows is several chunks."""
    binned = members.where("home").groupBy("label", "cell", _bin(F.col("dist")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("label", "cell").orderBy("bin")  # no more bins than 2 / BIN
    end = F.sum("n").over(order)
    numbered = binned.withColumns({"first": F.floor((end - F.col("n")) / chunk_rows).cast("int"), "last": F.floor((end - 1) / chunk_rows).cast("int")})
    bins = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("first", "last"))))
    by_cell = numbered.groupBy("label", "cell").agg(bins.alias("bins"))
    chunks = numbered.withColumn("chunk", F.explode(F.sequence("first", "last"))).groupBy("label", "cell", "chunk").agg((F.min("bin") * BIN).alias("lo"), ((F.max("bin") + 1) * BIN).alias("hi"))
    rings = chunks.groupBy("label", "cell").agg(F.collect_list(F.struct("chunk", "lo", "hi")).alias("rings"))
    return by_cell.join(rings, ["label", "cell"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """vec_id, label, n_links, component_id, kept of every vector (``vec_id, embedding, label``)."""
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * threshold)
    # Row numbers must not change when a task runs again, so the numbered rows are a written table.
    numbered = written(spark, vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("vector"), F.monotonically_increasing_id().alias("rid")), "vectors")
    usable = numbered.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    pivots = _pivots(usable, cell_rows, max_pivots)
    kind = numbered.schema["vector"].dataType.simpleString()
    schema = f"rid long, vec_id long, label int, cell int, dist double, home boolean, vector {kind}"
    members = written(spark, usable.mapInArrow(lean(_assigner(pivots, radius)), schema), "members")
    core = F.col("dist") <= radius / 2 - SLACK
    cells = members.groupBy("label", "cell").agg(F.coalesce(F.sum(core.cast("long")), F.lit(0)).alias("core_rows"), F.min(F.when(core, F.col("vec_id"))).alias("core_id"))
    cells = small(cells.join(_rings(members, chunk_rows), ["label", "cell"]), F.size("bins") + F.size("rings"))
    placed = members.join(cells, ["label", "cell"])
    columns = ["label", "cell", "chunk", "kind", "rid", "vec_id", "dist", "vector"]
    own = F.element_at("bins", _bin(F.col("dist")))
    deal = own["first"] + F.pmod(F.xxhash64(F.lit(SEED), "rid"), own["last"] - own["first"] + 1)
    homes = placed.where("home").withColumns({"chunk": deal.cast("int"), "kind": F.lit(0)}).select(columns)
    reach = F.lit(radius + SLACK)
    near = lambda g: (g["lo"] <= F.col("dist") + reach) & (g["hi"] >= F.col("dist") - reach)
    # rows around the pivot are counted, so they do not meet a chunk of nothing else
    counted_only = lambda g: core & (g["hi"] <= radius / 2 - SLACK)
    meets = F.filter("rings", lambda g: F.col("dist").isNull() | (near(g) & ~counted_only(g)))
    met = placed.withColumn("chunk", F.explode(F.transform(meets, lambda g: g["chunk"]))).withColumn("kind", F.lit(1)).select(columns)
    rows = homes.unionByName(met).repartition("label", "cell", "chunk").sortWithinPartitions("label", "cell", "chunk", "kind", "dist")
    found = written(spark, rows.mapInArrow(lean(_joiner(threshold, radius)), "kind int, a long, b long"), "found")
    # Members around a pivot are one another's links, all of them.
    inside = placed.where(core).select("rid", "vec_id", "home", "core_rows", "core_id")
    counted = found.where("kind = 0").select(F.col("a").alias("rid"), F.col("b").alias("n")).unionByName(inside.where("home").select("rid", (F.col("core_rows") - 1).alias("n")))
    counts = counted.groupBy("rid").agg(F.sum("n").alias("n_links"))
    edges = found.where("kind = 1").select("a", "b").unionByName(inside.select(F.col("vec_id").alias("a"), F.col("core_id").alias("b")))
    joined = components(edges)
    out = numbered.join(counts, "rid", "left").join(joined, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce(F.col("component"), F.col("vec_id"))
    return out.select("vec_id", "label", F.coalesce(F.col("n_links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op2_embedding_dedup(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
  SELECT a AS vec_id, b AS other FROM links
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (SELECT vec_id, min(other) AS other FROM reached GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c USING (vec_id) LEFT JOIN least l USING (vec_id)
"""
