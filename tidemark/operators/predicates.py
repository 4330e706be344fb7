"""Typed column predicates, compiled to Column expressions that Parquet can use.

Numbers are compared as IEEE doubles: a comparison with NaN is false, whichever
side it is on (Spark would order NaN above all).  A long is cast to double
before it is compared; where the bound is small enough for that cast to be
exact, the comparison is written on the long itself with a rounded bound, which
is the same and reaches the scan.  A predicate on a column of another type
matches nothing.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from ..errors import UnknownColumnError
from ..schema import DType, TableSchema
from ..session import share_package

_EXACT = float(1 << 53)


def at_least(c: Column, dtype: DType, bound: float) -> Column:
    """c >= bound as doubles."""
    if math.isnan(bound):
        return F.lit(False)
    if dtype.name == "F64":
        return c >= F.lit(float(bound))
    return c >= F.lit(math.ceil(bound)) if abs(bound) < _EXACT else c.cast("double") >= F.lit(float(bound))


def below(c: Column, dtype: DType, bound: float) -> Column:
    """c < bound as doubles."""
    if math.isnan(bound):
        return F.lit(False)
    if dtype.name == "F64":
        return c < F.lit(float(bound))
    return c < F.lit(math.ceil(bound)) if abs(bound) < _EXACT else c.cast("double") < F.lit(float(bound))


def above(c: Column, dtype: DType, bound: float) -> Column:
    """c > bound as doubles."""
    if math.isnan(bound):
        return F.lit(False)
    if dtype.name == "F64":
        return (c > F.lit(float(bound))) & ~F.isnan(c)
    return c > F.lit(math.floor(bound)) if abs(bound) < _EXACT else c.cast("double") > F.lit(float(bound))


class ColumnPredicate:
    """A condition on one column.

    Subclasses give `to_column`, or hooks on doubles (`f64_range`, `f64_gt`, used
    for F64 columns only and before anything else), or `test`, which gets a pandas
    Series and returns booleans: the way of last resort, batched through Arrow.
    """

    def __init__(self, column: str):
        self.column = column

    def f64_range(self) -> tuple[float, float] | None:
        return None

    def f64_gt(self) -> float | None:
        return None

    def to_column(self, c: Column, dtype: DType) -> Column | None:
        return None

    def test(self, values):
        raise NotImplementedError

    def compile(self, schema: TableSchema) -> Column:
        """The condition on a table of this schema; a column it does not have is an error."""
        d = schema.column(self.column)
        if d is None:
            raise UnknownColumnError(self.column)
        c = F.col(f"`{self.column}`")
        if d.dtype.name == "F64" and (r := self.f64_range()) is not None:
            return at_least(c, d.dtype, r[0]) & below(c, d.dtype, r[1]) & ~F.isnan(c)
        if d.dtype.name == "F64" and (t := self.f64_gt()) is not None:
            return above(c, d.dtype, t)
        made = self.to_column(c, d.dtype)
        if made is not None:
            return made
        if type(self).test is ColumnPredicate.test:
            return F.lit(False)
        test = self.test
        if spark := SparkSession.getActiveSession():
            share_package(spark)

        def run(values: pd.Series) -> pd.Series:
            return test(values)

        return F.pandas_udf(run, "boolean")(c)


class RangePredicate(ColumnPredicate):
    """low <= value < high."""

    def __init__(self, column: str, low: float, high: float):
        super().__init__(column)
        self.low, self.high = low, high

    def f64_range(self):
        return self.low, self.high

    def to_column(self, c, dtype):
        return at_least(c, dtype, self.low) & below(c, dtype, self.high) if dtype.numeric else F.lit(False)


class GtPredicate(ColumnPredicate):
    """value > bound."""

    def __init__(self, column: str, bound: float):
        super().__init__(column)
        self.bound = bound

    def f64_gt(self):
        return self.bound

    def to_column(self, c, dtype):
        return above(c, dtype, self.bound) if dtype.numeric else F.lit(False)


class ScalarPredicate(ColumnPredicate):
    """The exact bytes of a FixedStr, padding included."""

    def __init__(self, column: str, value: bytes):
        super().__init__(column)
        self.value = bytes(value)

    def to_column(self, c, dtype):
        return F.lit(False) if dtype.numeric else c == F.lit(bytearray(self.value))
