"""Gathering rows, uniting segments, and segment statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import BatchError


def take_indices(df: DataFrame, position: str, indices: Sequence[int]) -> DataFrame:
    """Rows at the given positions, in that order and with repeats; `_at` is the order.

    position: a column of row numbers.  The list comes from the caller, so its size is known.
    """
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), f"_at long, {position} long")
    hit = df.where(F.col(position).isin(sorted(set(indices)))) if len(indices) <= 1000 else df
    joined = hit.join(F.broadcast(wanted) if len(indices) <= 100_000 else wanted, position)
    return joined.select("_at", *[f"`{c}`" for c in df.columns])


def row_at(df: DataFrame, position: str, index: int) -> DataFrame:
    """The row at one position (none if out of range)."""
    return df.where(F.col(position) == index)


def union_segments(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; names, order and types must agree."""
    first = parts[0]
    for p in parts[1:]:
        if [(f.name, f.dataType) for f in p.schema] != [(f.name, f.dataType) for f in first.schema]:
            raise BatchError(f"segments differ: {p.schema.simpleString()} and {first.schema.simpleString()}")
    out = first
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=False)
    return out


def segment_stats(df: DataFrame, segment: Column, time: Column) -> DataFrame:
    """segment_id, row_count, min_ts, max_ts."""
    return df.groupBy(segment.alias("segment_id")).agg(F.count("*").alias("row_count"), F.min(time).alias("min_ts"), F.max(time).alias("max_ts"))


def prune(stats: DataFrame, start: int, end: int) -> DataFrame:
    """Segments that may hold rows in [start, end): an empty range has none."""
    return stats.where(F.lit(start < end) & (F.col("max_ts") >= start) & (F.col("min_ts") < end))


def missing_segments(spark: SparkSession, requested: Sequence[int], present: DataFrame) -> DataFrame:
    """Requested ids that are not present."""
    return spark.createDataFrame([(i,) for i in set(requested)], "segment_id long").join(present, "segment_id", "left_anti")


def differences(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """Positions at which two results differ (none: they are equal in order), with where they differ.

    Names, order and types must agree.  Values are compared, not how they are
    stored; not-a-number equals nothing, itself included; nulls are equal.
    """
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise BatchError(f"results differ: {a.schema.simpleString()} and {b.schema.simpleString()}")
    values = [f for f in a.schema.fields if f.name != position]
    packed = lambda df, name: df.select(position, F.struct(*[f"`{f.name}`" for f in values]).alias(name))
    joined = packed(a, "_a").join(packed(b, "_b"), position, "full")

    def differs(f) -> Column:
        x, y = F.col("_a").getField(f.name), F.col("_b").getField(f.name)
        other = ~x.eqNullSafe(y)
        return other | F.coalesce(F.isnan(x), F.lit(False)) if f.dataType.typeName() in ("double", "float") else other

    named = F.array_compact(F.array(*[F.when(differs(f), F.lit(f.name)) for f in values]))
    where = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.array(F.lit("missing"))).otherwise(named)
    return joined.select(position, where.alias("columns")).where(F.size("columns") > 0)
