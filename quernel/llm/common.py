"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.session import shared_folder, ship

# Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/quernel-{tag}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df as a written table: later steps read files, so the lineage ends here and survives lost executors."""
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quernel_path = path
    return out


#: Rows of totals (under 100 bytes each but for a name) that may be broadcast.
BROADCAST_ROWS = 100_000


def small(totals: DataFrame, entries: Column | None = None) -> DataFrame:
    """totals as a written table, broadcast if it has at most BROADCAST_ROWS rows (or entries, for rows that hold several).
    Beyond, both sides of a join are shuffled as they are read, so that Spark can split a hot key."""
    table = written(totals.sparkSession, totals, "totals")
    size = table.count() if entries is None else table.agg(F.sum(entries)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_ROWS else table


def spread(spark: SparkSession) -> int:
    """How many tasks a shuffle has that must not be coalesced: rows that are few now but become many."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete what written() wrote for tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_quernel_path", None)
        if path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tidy(spark: SparkSession) -> str:
    """Have the driver forget plans that nobody holds any more, and give memory back: Spark deletes the shuffle files of those
    that its collector finds gone, and by itself the collector may not run for half an hour.  What the JVM says of the trim."""
    trim()
    spark._jvm.System.gc()
    return _trim_jvm(spark)


def trim() -> None:
    """Python's unused memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def _trim_jvm(spark: SparkSession) -> str:
    """So does what the driver's JVM holds beside its heap: the C library keeps much of what was freed (the README has a
    measurement).  Nothing where the JVM has no such command."""
    jvm = spark._jvm
    try:
        values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's class is not open to callers, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values))
    except Py4JError:
        return ""


def lean(run):
    """An Arrow function that gives memory back when its task ends, since workers live on beside the JVM.  Whoever plans
    with one has this package sent to the executors."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    @functools.wraps(run)
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return outer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def held_out(doc_id: Column) -> Column:
    """Rows kept away from training: crc32(doc_id as text) mod 5 is 0. A null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
