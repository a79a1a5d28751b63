"""Arrow in and out: bulk loads of pyarrow tables and typed or textual results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.sources.table import Table, default_column


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of a schema, by name: cast, in its order, missing ones with their default."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name) if f.name.lower() in have else default_column(f.dataType).alias(f.name) for f in schema.fields])


def bulk_load(table: Table, data: pa.Table | pa.RecordBatch) -> int:
    """Append an Arrow table as data files, past the insert buffer."""
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if not data.num_rows:
        return 0
    return table.append(frame(table.spark, data))


def frame(spark: SparkSession, data: pa.Table) -> DataFrame:
    return spark.createDataFrame(data)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def batches(df: DataFrame, rows: int = 4096) -> Iterator[list]:
    """The result in lists of rows, one partition at a time on the driver."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def _as_bytes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        # by copy, so that a slice does not carry what it was cut from
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, part.schema) as writer:
            writer.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["ipc"])


def record_batches(df: DataFrame) -> tuple[pa.Schema, Iterator[pa.RecordBatch]]:
    """The result's schema and its record batches in order, one partition at a time on the driver."""
    schema = to_arrow_schema(df.schema)

    def stream() -> Iterator[pa.RecordBatch]:
        for row in df.mapInArrow(_as_bytes, "ipc binary").toLocalIterator():
            for part in pa.ipc.open_stream(row.ipc):
                # the optimiser may know a column to have no nulls where the declared schema does not
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(part.columns, schema, strict=True)], schema=schema)

    return schema, stream()


def to_text(df: DataFrame, limit: int | None = None) -> str:
    """Cells between bars, a line for each row; nulls as NULL."""
    return "\n".join(text_lines(df if limit is None else df.limit(limit)))


def text_lines(df: DataFrame) -> Iterator[str]:
    """The same line by line, one partition at a time on the driver."""
    yield " | ".join(df.columns)
    for row in df.toLocalIterator():
        yield " | ".join("NULL" if v is None else str(v) for v in row)
