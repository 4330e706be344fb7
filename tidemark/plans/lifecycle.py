"""Queries that run a whole table: append, flush, reopen, recover, compact.

Each makes a table in a folder of its own from the events, in three batches by
event_id mod 3, and returns what is visible in the end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TableSchema
from ..sources.generate import trades
from ..sources.raw import encode_payload
from ..sources.table import Table
from .events import DAY, NEXT_DAY, SCHEMA, _SHOWN, events, shown

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder: in spark.checkpoint.dir, which executors share, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/tidemark/table-{uuid.uuid4().hex[:12]}" if root else tempfile.mkdtemp(prefix="tidemark-table-")
    if urlparse(path).scheme in ("", "file"):
        atexit.register(shutil.rmtree, urlparse(path).path, ignore_errors=True)
    return path


def _batches(spark, sf_dir) -> list[DataFrame]:
    df = events(spark, sf_dir).select(*SCHEMA.names)
    return [df.where(F.col("event_id") % 3 == i) for i in range(3)]


def _open(spark) -> Table:
    return Table.open(spark, _folder(spark), SCHEMA)


@query(f"SELECT {_SHOWN} FROM events WHERE epoch_ns(ts) >= {DAY} AND epoch_ns(ts) < {NEXT_DAY}")
def append_visible(spark, sf_dir):
    t = _open(spark)
    for b in _batches(spark, sf_dir):
        t.append(b)
    return shown(t.scan_time_range(DAY, NEXT_DAY))


@query(f"SELECT {_SHOWN} FROM events")
def flush_reopen(spark, sf_dir):
    t = _open(spark)
    one, two, three = _batches(spark, sf_dir)
    t.append(one)
    t.append(two)
    t.flush()
    t.append(three)
    t = Table.open(spark, t.path, SCHEMA)
    return shown(t.scan_time_range(-(1 << 63), (1 << 63) - 1))


@query(f"SELECT {_SHOWN} FROM events WHERE event_id % 3 = 2")
def wal_tail(spark, sf_dir):
    t = _open(spark)
    one, two, three = _batches(spark, sf_dir)
    t.append(one)
    t.append(two)
    t.flush()
    t.append(three)
    return shown(t.wal_tail())


@query(f"SELECT event_id % 3 AS record, {_SHOWN} FROM events")
def recover_batches(spark, sf_dir):
    t = _open(spark)
    for b in _batches(spark, sf_dir):
        t.append(b)
    t.flush()
    df = t.recover_batches()
    return df.select(F.col("_rec").alias("record"), *[c for c in shown(df).columns if c != "sym"], F.col("sym").cast("string").alias("sym"))


@query("SELECT event_id % 3 AS record, count(*) AS rows FROM events GROUP BY 1")
def recover_records(spark, sf_dir):
    t = _open(spark)
    for b in _batches(spark, sf_dir):
        t.append(b)
    t.flush()
    return t.recover_records().withColumnRenamed("_rec", "record")


@query("SELECT event_id % 3 AS record, count(*) AS rows, count(*) * 44 AS value_bytes FROM events GROUP BY 1")
def recover_payloads(spark, sf_dir):
    """The log as bytes: rows, and bytes of values (four numbers, and eight bytes with their length)."""
    t = _open(spark)
    for b in _batches(spark, sf_dir):
        t.append(b)
    head = len(encode_payload(SCHEMA, {c: [] for c in SCHEMA.names}))
    return t.recover_payloads().groupBy(F.col("_rec").alias("record")).agg(F.sum("rows").alias("rows"), F.sum(F.octet_length("payload") - head).cast("long").alias("value_bytes"))


def _compacted(spark, sf_dir) -> Table:
    t = _open(spark)
    for b in _batches(spark, sf_dir):
        t.append(b)
        t.flush()
    t.compact([1, 2])
    return t


@query(f"SELECT {_SHOWN} FROM events")
def compact(spark, sf_dir):
    return shown(_compacted(spark, sf_dir).scan_time_range(-(1 << 63), (1 << 63) - 1))


@query(
    """SELECT CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END::BIGINT AS place, CASE WHEN event_id % 3 = 2 THEN 3 ELSE 4 END::BIGINT AS segment_id,
  CASE WHEN event_id % 3 = 2 THEN 'segments/seg-000003' ELSE 'segments/seg-000004' END AS path,
  count(*) AS row_count, min(epoch_ns(ts)) AS min_ts, max(epoch_ns(ts)) AS max_ts FROM events GROUP BY 1, 2, 3"""
)
def compact_manifest(spark, sf_dir):
    return _compacted(spark, sf_dir).manifest_rows()


@query("SELECT event_id, epoch_ns(ts) AS ns FROM events")
def narrow_open(spark, sf_dir):
    """A table opened with a part of its columns, compacted, and read again."""
    at = _compacted(spark, sf_dir).path
    part = TableSchema(SCHEMA.name, [c for c in SCHEMA.columns if c.name in ("ns", "event_id")])
    t = Table.open(spark, at, part)
    t.compact([s.id for s in t.manifest.sealed_segments])
    return Table.open(spark, at, part).scan_time_range(-(1 << 63), (1 << 63) - 1)


@query(
    """SELECT i AS timestamp, CASE WHEN i % 2 = 0 THEN 'EURUSD  ' ELSE 'BTCUSD  ' END AS symbol,
  100::DOUBLE + (i % 10000) * 0.01::DOUBLE AS price, (1 + i % 100)::DOUBLE AS volume
FROM range(20000) r(i) WHERE 100::DOUBLE + (i % 10000) * 0.01::DOUBLE >= 100 AND 100::DOUBLE + (i % 10000) * 0.01::DOUBLE < 110"""
)
def gen_trades(spark, sf_dir):
    from ..operators.predicates import RangePredicate
    from ..sources.generate import TRADES

    df = trades(spark, 10_000).unionByName(trades(spark, 10_000, 10_000))
    return df.where(RangePredicate("price", 100.0, 110.0).compile(TRADES)).withColumn("symbol", F.col("symbol").cast("string"))
