"""A generator of trades, the engine's own workload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import F64, TIMESTAMP, TableSchema, fixed_str

TRADES = TableSchema("trades", [("timestamp", TIMESTAMP), ("symbol", fixed_str(8)), ("price", F64), ("volume", F64)])


def trades(spark: SparkSession, rows: int, first: int = 0, partitions: int | None = None) -> DataFrame:
    """rows trades from running number `first` on: symbols alternate, prices and volumes cycle."""
    i = F.col("id")
    local = i - first
    symbol = F.when(local % 2 == 0, "EURUSD  ").otherwise("BTCUSD  ").cast("binary")
    base = spark.range(first, first + rows, 1, partitions) if partitions else spark.range(first, first + rows)
    return base.select(i.alias("timestamp"), symbol.alias("symbol"), (100.0 + (i % 10000) * F.lit(0.01)).alias("price"), (1.0 + (i % 100)).cast("double").alias("volume"))
