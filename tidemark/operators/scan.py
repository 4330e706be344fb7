"""Time-range scans over any DataFrame with a time column.

Bounds are nanoseconds, half-open.  On a long column they are used as they are;
on a TIMESTAMP_NTZ column (microseconds) they are rounded up to microseconds and
written as literals against the bare column, so that both reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import UnknownColumnError
from ..schema import TableSchema
from .predicates import ColumnPredicate

_EPOCH = dt.datetime(1970, 1, 1)
_FIRST = (dt.datetime.min - _EPOCH) // dt.timedelta(microseconds=1)
_LAST = (dt.datetime.max - _EPOCH) // dt.timedelta(microseconds=1)


def ns_of(c: Column) -> Column:
    """Nanoseconds of a TIMESTAMP_NTZ column, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c) * F.lit(1000).cast("long")


def time_range(df: DataFrame, column: str, start: int, end: int) -> Column:
    """start <= column < end."""
    if column not in df.columns:
        raise UnknownColumnError(column)
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if start >= end:
        return F.lit(False)
    if isinstance(kind, T.LongType):
        return (c >= F.lit(start)) & (c < F.lit(end))
    if not isinstance(kind, T.TimestampNTZType):
        raise TypeError(f"{column} is {kind.simpleString()}; a time column is bigint or timestamp_ntz")
    lo, hi = -(-start // 1000), -(-end // 1000)
    if lo > _LAST or hi <= _FIRST:
        return F.lit(False)
    literal = lambda us: F.expr(f"TIMESTAMP_NTZ'{(_EPOCH + dt.timedelta(microseconds=us)).isoformat(sep=' ')}'")
    out = c.isNotNull()
    if lo > _FIRST:
        out &= c >= literal(lo)
    if hi <= _LAST:
        out &= c < literal(hi)
    return out


def scan_time_range(df: DataFrame, column: str, start: int, end: int) -> DataFrame:
    """All columns of the rows in [start, end); empty ranges keep the schema."""
    return df.where(time_range(df, column, start, end))


def scan_where(df: DataFrame, column: str, start: int, end: int, predicate: ColumnPredicate, schema: TableSchema) -> DataFrame:
    """Rows in [start, end) that fulfil the predicate, as one filter."""
    condition = predicate.compile(schema)  # raises for unknown columns, even if nothing matches
    return df.where(time_range(df, column, start, end) & condition)


def project(df: DataFrame, *columns: str) -> DataFrame:
    """Columns by name, in the order given."""
    for c in columns:
        if c not in df.columns:
            raise UnknownColumnError(c)
    return df.select(*[f"`{c}`" for c in columns])


def values(df: DataFrame, column: str, schema: TableSchema, kind: str) -> list:
    """A column's values on the driver. kind: F64, I64 (which takes times as well), Timestamp or FixedStr."""
    d = schema.column(column)
    if d is None:
        raise UnknownColumnError(column)
    if d.dtype.name != kind and not (kind == "I64" and d.dtype.name == "Timestamp"):
        raise TypeError(f"{column} is {d.dtype.name}, not {kind}")
    got = df.select(f"`{column}`").toArrow().column(0).to_pylist()
    return [bytes(v) for v in got] if kind == "FixedStr" else got
