"""Scans, filters, joins, aggregates and sorts as DataFrame compositions.

Everything here is lazy and leaves physical choices to Spark: which side of a join is broadcast is decided
by size, aggregates combine before they shuffle, and filters and columns reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.graph import kept

COMPARE = {
    "=": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "<>": lambda c, v: c != v,
}

AGGREGATES = {
    "count": lambda c: F.count(F.lit(1)),
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
}


def compare(column: str, sign: str, value) -> Column:
    return COMPARE[sign](F.col(column), value)


# Scans and projections


def point_lookup(table: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; row-group statistics skip the rest."""
    return table.where(F.col(key) == value)


def filtered_keys(table: DataFrame, key: str, condition: Column) -> DataFrame:
    """The keys of the rows that fulfil a condition; reads only the columns of both."""
    return table.where(condition).select(key)


def project(table: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns by new name, in the given order; an unknown column is an error."""
    return table.select(*[F.col(old).alias(new) for new, old in columns.items()])


# Counts


def count_matching(table: DataFrame, condition: Column, out: str = "cnt") -> DataFrame:
    return table.where(condition).agg(F.count(F.lit(1)).alias(out))


def shared_counts(table: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Many counts in one pass over the table: a row (name, cnt) for each condition."""
    names = list(conditions)
    counted = table.agg(*[F.count_if(conditions[n]).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("cnt")) for i, n in enumerate(names)])
    return counted.select(F.explode(pairs).alias("p")).select("p.name", "p.cnt")


def shared_threshold_counts(table: DataFrame, column: str, thresholds: Sequence[int]) -> DataFrame:
    """threshold, cnt of rows above it, all in one pass."""
    found = shared_counts(table, {str(t): F.col(column) > t for t in thresholds})
    return found.select(F.col("name").cast("long").alias("threshold"), "cnt")


# Joins


def lookup_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, newest: str, columns: Sequence[str]) -> DataFrame:
    """Each probe row with at most one build row: of a key's rows the one with the greatest ``newest``.

    The newest row is an aggregate (combined before the shuffle), so a hot build key stays small.
    """
    last = build.where(F.col(build_key).isNotNull()).groupBy(F.col(build_key).alias("__key")).agg(F.max_by(F.struct(*columns), F.col(newest)).alias("__row"))
    return probe.join(last, F.col(probe_key) == F.col("__key")).select(*probe.columns, *[F.col(f"__row.{c}").alias(c) for c in columns])


def semi_filter(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    """Probe rows whose key the build side has, exactly."""
    return probe.join(build.select(F.col(build_key).alias("__key")), F.col(probe_key) == F.col("__key"), "left_semi")


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """A fact table joined to each (dimension, fact key, dimension key) in turn."""
    out = fact
    for dimension, fact_key, key in dimensions:
        out = out.join(dimension, F.col(fact_key) == F.col(key))
    return out


# Aggregates


def scalar_aggregates(table: DataFrame, wanted: Mapping[str, tuple[str, str]], condition: Column | None = None) -> DataFrame:
    """out -> (function, column); over no rows counts are 0 and the rest null."""
    rows = table if condition is None else table.where(condition)
    return rows.agg(*[AGGREGATES[function](F.col(column) if column != "*" else F.lit(1)).alias(out) for out, (function, column) in wanted.items()])


def grouped(table: DataFrame, keys: Sequence[str], wanted: Mapping[str, Column], having: Column | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Group, filter groups, order and limit, in the order SQL does."""
    out = table.groupBy(*keys).agg(*[column.alias(name) for name, column in wanted.items()])
    if having is not None:
        out = out.where(having)
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


# Sorting


def top_rows(table: DataFrame, order: Sequence[Column], limit: int, rank: str = "rn") -> DataFrame:
    """The first rows in an order, each with its place; only ``limit`` rows of a task leave it."""
    first = table.orderBy(*order).limit(limit)
    return first.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def ranked_rows(table: DataFrame, order: Sequence[Column], rank: str = "rn") -> DataFrame:
    """Every row with its place in a total order: rows are dealt by range and kept, so that a place is the rows of
    the ranges before and the place within one; only a count of each range goes through a single task."""
    parts, _ = kept(table.sparkSession, table.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "__part").withColumn(rank, place).drop("__part", "__before")


# Dictionaries


def dictionary(table: DataFrame, column: str, position: str) -> DataFrame:
    """value, id: dense ids from 0 in order of first appearance."""
    first = table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(position).alias("__first"))
    # values are numbered range by range, so no task orders them all
    return ranked_rows(first, [F.col("__first"), F.col("value")], "__place").select("value", (F.col("__place") - 1).cast("int").alias("id"))


def encode(table: DataFrame, column: str, known: DataFrame, out: str) -> DataFrame:
    """The column's id in a dictionary; null where it has none."""
    return table.join(known.select(F.col("value").alias("__value"), F.col("id").alias(out)), F.col(column) == F.col("__value"), "left").drop("__value")


def decode(table: DataFrame, column: str, known: DataFrame, out: str) -> DataFrame:
    return table.join(known.select(F.col("id").alias("__id"), F.col("value").alias(out)), F.col(column) == F.col("__id"), "left").drop("__id")
