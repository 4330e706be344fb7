"""Admission of block requests and packet queues: each rule a column expression, lookups joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scalars import lba_range


def namespace_error(nsid: Column, sector: Column, capacity: Column, most: Column) -> Column:
    """The first property of a namespace that is not above 0; null if all are."""
    return F.when(nsid <= 0, "nsid").when(sector <= 0, "sector_size").when(capacity <= 0, "capacity").when(most <= 0, "max_io_size")


def queue_error(queue: Column, configured: Column) -> Column:
    """`InvalidQueue` for a queue that is not configured; null for others."""
    return F.when((queue < 0) | (queue >= configured), "InvalidQueue")


def port_error(kind: Column, port: Column, configured: Column) -> Column:
    """`InvalidTarget` for what is no network port, `PortMismatch` for another one; null for the port itself."""
    return F.when(~kind.eqNullSafe(F.lit("port")), "InvalidTarget").when(~port.eqNullSafe(configured), "PortMismatch")


def admit(requests: DataFrame, namespaces: DataFrame, queues: DataFrame) -> DataFrame:
    """requests with error, lba, count and queue, the least queue id.

    requests: kind, nsid, offset, length.  namespaces: nsid, sector_size, capacity,
    max_io_size, one row each.  queues: queue_id.  The first rule that a request
    breaks is its error: its kind, its namespace, its range, then a missing queue.
    The namespaces are joined by Spark's own choice, so they may be many.
    """
    first = queues.agg(F.min("queue_id").alias("queue"))  # one row, whatever queues holds
    known = namespaces.select("nsid", F.struct("sector_size", "capacity", "max_io_size").alias("_ns"))
    joined = requests.join(known, "nsid", "left").withColumn("queue", first.scalar())
    n = F.col("_ns")
    joined = joined.withColumn("_range", lba_range(F.col("offset"), F.col("length"), n["sector_size"], n["capacity"], n["max_io_size"]))
    error = (
        F.when(~F.col("kind").eqNullSafe(F.lit("namespace")), "InvalidTarget")
        .when(n.isNull(), "NamespaceNotFound")
        .when(F.col("_range.error").isNotNull(), F.col("_range.error"))
        .when(F.col("queue").isNull(), "NoQueuePairs")
    )
    out = joined.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), F.col(c))
    return out.select(*[f"`{c}`" for c in requests.columns], "error", good("_range.lba").alias("lba"), good("_range.count").alias("count"), good("queue").alias("queue"))
