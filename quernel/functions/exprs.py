"""Column expressions beyond Spark's built-ins; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def null_like(value: Column | str, kind: T.DataType) -> Column:
    """Null, or what a table without nulls stores for it: 0 or the empty string."""
    column = _column(value)
    if isinstance(kind, T.StringType):
        return column.isNull() | (column == "")
    if isinstance(kind, T.NumericType):
        return column.isNull() | (column == 0)
    if isinstance(kind, T.ArrayType):
        return column.isNull() | (F.size(column) == 0)
    return column.isNull()


def absolute(value: Column | str) -> Column:
    return F.abs(_column(value).cast("long"))


def negated(value: Column | str) -> Column:
    return F.negative(_column(value).cast("long"))


def squared(value: Column | str) -> Column:
    """As a long, so that no int overflows."""
    column = _column(value).cast("long")
    return column * column


#: Scalar functions by name.
SCALARS = {"ABS": absolute, "NEGATE": negated, "SQUARE": squared}


def arithmetic(column: Column | str, sign: str, operand: Column | int | float, kind: T.DataType) -> Column:
    """column sign operand in the column's own type: whole-number division truncates toward zero, division by
    zero leaves the value, a result beyond the type is null rather than wrapped."""
    left = _column(column)
    right = operand if isinstance(operand, Column) else F.lit(operand)
    whole = isinstance(kind, T.IntegralType)
    if sign == "/":
        quotient = _whole_quotient(left, right) if whole else left / F.nullif(right, F.lit(0))
        return F.when(right == 0, left).otherwise(quotient).cast(kind)
    exact = left.cast("long") if whole else left
    result = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign](exact, right.cast("long") if whole else right)
    return result.try_cast(kind)


def _whole_quotient(left: Column, right: Column) -> Column:
    """Truncated toward zero; the divisor is not zero where this counts."""
    safe = F.when(right == 0, F.lit(1)).otherwise(right).cast("long")
    left = left.cast("long")
    return (left - left % safe) / safe


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def cosine(vector: Column | str, query: Sequence[float]) -> Column:
    """Cosine similarity with a constant vector; null for a zero or null vector or one of another length."""
    column = _column(vector)
    wanted = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    own = F.sqrt(F.aggregate(column, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    score = dot(column, wanted) / F.nullif(own * F.lit(length), F.lit(0.0))
    return F.when(F.size(column) == len(query), score)


def cosine_sql(column: str, query: Sequence[float]) -> str:
    """The same as SQL text, for a column as a statement names it."""
    wanted = ", ".join(f"{float(x)!r}D" for x in query)
    length = sum(float(x) ** 2 for x in query) ** 0.5
    own = f"sqrt(aggregate({column}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
    product = f"aggregate(zip_with({column}, array({wanted}), (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)"
    return f"(CASE WHEN size({column}) = {len(query)} THEN {product} / nullif({own} * {length!r}D, 0D) END)"


def vector_signature(vector: Column | str) -> Column:
    """A 64-bit hash; equal vectors have equal ones."""
    return F.xxhash64(_column(vector))
