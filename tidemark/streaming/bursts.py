"""Packet bursts: binary frames with the queue they came by, as a stream, and sent as files by queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import BatchError
from ..functions.devices import queue_error

SCHEMA = "queue int, packet binary"


def receive(spark: SparkSession, folder: str, queue: int, queues: int, max_files: int = 64) -> DataFrame:
    """A stream of one queue's packets from Parquet files; max_files bounds a micro-batch."""
    if not 0 <= queue < queues:
        raise BatchError(f"queue {queue} is not one of {queues}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder).where(F.col("queue") == queue)


def send(packets: DataFrame, folder: str, queues: int) -> DataFrame:
    """Write a burst; an empty one and unknown queues are errors. Returns packets and bytes by queue.

    Queues are checked while rows are written, so the burst is read once; nothing is shuffled.
    """
    if not packets.head(1):
        raise BatchError("the burst is empty")
    wrong = queue_error(F.col("queue"), F.lit(queues))
    packets.withColumn("queue", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("queue"))).write.mode("append").parquet(folder)
    return sent(packets)


def sent(packets: DataFrame) -> DataFrame:
    """queue, packets, bytes."""
    return packets.groupBy("queue").agg(F.count("*").alias("packets"), F.sum(F.octet_length("packet")).cast("long").alias("bytes"))
