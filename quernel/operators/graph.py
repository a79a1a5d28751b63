"""Breadth-first distances over an edge table."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quernel.session import shared_folder


def edges_of(table: DataFrame, source: str, target: str) -> DataFrame:
    """The distinct directed edges (src, dst) of a table."""
    return table.select(F.col(source).cast("long").alias("src"), F.col(target).cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def kept(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, int]:
    """df as a table in the shared folder, and its rows."""
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)  # counted as it is written
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


class _Reached:
    """Nodes with their distance in few tables: one of at most twice another's rows is merged with it, so a node is
    written again a number of times that grows with the logarithm of all, and a hop reads as few tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts = spark, []

    def add(self, part: DataFrame, rows: int) -> None:
        while self.parts and self.parts[-1][1] <= 2 * rows and len(self.parts) > 1:
            last, more = self.parts.pop()
            part, rows = kept(self.spark, last.unionByName(part))
        self.parts.append((part, rows))

    def table(self) -> DataFrame:
        out = self.parts[0][0]
        for part, _ in self.parts[1:]:
            out = out.unionByName(part)
        return out


def bfs_distance(table: DataFrame, start: int, source: str, target: str) -> DataFrame:
    """node, distance (hops) of every node that start reaches, itself at 0 if it lies in the graph's range of ids.

    One job a hop: the frontier joins the edges it leaves by and drops nodes already reached.  Each hop is kept
    in the shared folder, so the plan stays short and lost executors cost one hop.  The hops that there are bound the
    loop: it ends with the first that finds no new node.
    """
    spark = table.sparkSession
    edges, _ = kept(spark, edges_of(table, source, target))
    most = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    if most is None or not 0 <= start <= most:
        return spark.createDataFrame([], "node long, distance int")
    frontier = spark.createDataFrame([(start, 0)], "node long, distance int")
    reached = _Reached(spark)
    reached.add(frontier, 1)
    for hop in itertools.count(1):
        found = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier, rows = kept(spark, found.join(reached.table().select("node"), "node", "left_anti").withColumn("distance", F.lit(hop)))
        if not rows:
            return reached.table()
        reached.add(frontier, rows)
