"""Structured Streaming into a table: one append a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.batch import reorder
from ..sources.table import Table


def ingest(stream: DataFrame, table: Table, checkpoint: str, flush_every: int = 0, **trigger):
    """Start a query that appends each micro-batch of stream, and seals after every `flush_every` of them.

    A micro-batch that is run again after a failure is recognised by its number, kept
    beside the table, and not appended twice.
    """

    def step(df: DataFrame, number: int) -> None:
        mark = f"stream-{number:010d}"
        if table.store.exists(f"streamed/{mark}"):
            return
        before = table.records
        table.append(reorder(df, table.schema))
        table.store.replace_text(f"streamed/{mark}", str(before))
        if flush_every and (number + 1) % flush_every == 0:
            table.flush()

    table.store.make_dirs("streamed")
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
