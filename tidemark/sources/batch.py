"""Batches of rows, checked against a table's schema before anything is written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import BatchError
from ..schema import TableSchema


def batch(spark: SparkSession, schema: TableSchema, columns: Mapping[str, Sequence]) -> DataFrame:
    """A DataFrame in schema order from columns in any order.

    Names, number of rows, value types and widths must fit.
    """
    if missing := [c for c in schema.names if c not in columns]:
        raise BatchError(f"missing columns {missing}")
    if extra := [c for c in columns if c not in schema.names]:
        raise BatchError(f"unknown columns {extra}")
    expected = len(columns[schema.names[0]])
    for c in schema.columns:
        got = columns[c.name]
        if len(got) != expected:
            raise BatchError(f"{c.name}: expected {expected} rows, got {len(got)}")
        for v in got:
            if c.dtype.name == "FixedStr":
                if not isinstance(v, (bytes, bytearray)) or len(v) != c.dtype.width:
                    raise BatchError(f"{c.name}: {v!r} is not {c.dtype.width} bytes")
            elif isinstance(v, bool) or not isinstance(v, float if c.dtype.name == "F64" else int):
                raise BatchError(f"{c.name}: {v!r} is not {c.dtype.name}")
    rows = list(zip(*(columns[c] for c in schema.names)))
    return spark.createDataFrame(rows, schema.spark())


def reorder(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Columns in schema order."""
    if sorted(df.columns) != sorted(schema.names):
        raise BatchError(f"columns are {df.columns}, not {schema.names}")
    return df.select(*[f"`{c}`" for c in schema.names])


def check_columns(df: DataFrame, schema: TableSchema) -> None:
    """Names in order and types; nothing is read."""
    if df.columns != schema.names:
        raise BatchError(f"columns are {df.columns}, not {schema.names}")
    for f, c in zip(df.schema.fields, schema.columns):
        if f.dataType != c.dtype.spark:
            raise BatchError(f"{f.name} is {f.dataType.simpleString()}, not {c.dtype.name}")


def checked(df: DataFrame, schema: TableSchema) -> DataFrame:
    """df, failing at run time on nulls and on FixedStr values of a wrong width: checked as rows are written."""

    def value(name: str, kind: T.DataType, width: int | None) -> Column:
        c = F.col(f"`{name}`")
        out = F.when(c.isNull(), F.raise_error(F.lit(f"{name}: null")).cast(kind)).otherwise(c)
        if width:
            out = F.when(F.octet_length(c) != width, F.raise_error(F.lit(f"{name}: not {width} bytes")).cast(kind)).otherwise(out)
        return out.alias(name)

    return df.select(*[value(c.name, c.dtype.spark, c.dtype.width) for c in schema.columns])
