"""Benchmark history: JSON lines, the latest record of a name, and changes between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.scalars import percent_delta

SCHEMA = T.StructType(
    [
        T.StructField("benchmark", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("units", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("rate_per_sec", T.DoubleType()),
        T.StructField("mib_per_sec", T.DoubleType()),
        T.StructField("context", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.LongType())]))),
        T.StructField("timestamp_ms", T.LongType()),
    ]
)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines file; one bad line fails the read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def append_history(df: DataFrame, path: str) -> None:
    df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields]).write.mode("append").json(path)


def latest(df: DataFrame, name: str, order: Column) -> DataFrame:
    """The last record of each name by order (not by time): one aggregation, no sort."""
    rest = [c for c in df.columns if c != name]
    last = df.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(name, *[F.col(f"_last.`{c}`").alias(c) for c in rest])


def deltas(df: DataFrame, name: str, order: Column, rate: str) -> DataFrame:
    """df with the rate of the run before (`previous`) and the change in percent."""
    before = F.lag(rate).over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("previous", before).withColumn("delta_percent", percent_delta(F.col("previous"), F.col(rate)))
