import os

import pytest
from pyspark.sql import functions as F

from tidemark.errors import BatchError, LogError, SchemaError, UnknownSegmentError
from tidemark.operators.predicates import RangePredicate
from tidemark.schema import F64, I64, TIMESTAMP, TableSchema, fixed_str
from tidemark.sources.batch import batch
from tidemark.sources.generate import TRADES, trades
from tidemark.sources.table import Table
from tidemark.streaming.ingest import ingest

PV = TableSchema("ticks", [("timestamp", TIMESTAMP), ("price", F64), ("volume", I64)])
ROWS = [(10, 1.0, 100), (20, 2.0, 200), (30, 3.0, 300), (40, 4.0, 400)]


def ticks(spark, rows=ROWS):
    return batch(spark, PV, dict(zip(PV.names, map(list, zip(*rows)))))


def prices(df):
    return [r["price"] for r in df.collect()]


def test_append_flush_scan(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", PV)
    assert t.append(ticks(spark)) == 4 and t.row_count == 4
    got = t.scan_where(0, 35, RangePredicate("price", 2.5, 5.0)).collect()
    assert [r["volume"] for r in got] == [300]
    s = t.flush()
    assert (s.id, s.path, s.row_count, s.min_ts, s.max_ts) == (1, "segments/seg-000001", 4, 10, 40)
    assert t.row_count == 0 and t.sealed_segment_count == 1 and t.manifest.log_records_applied == 1 and t.flush() is None
    assert prices(t.scan_time_range(15, 35, ordered=True)) == [2.0, 3.0]
    assert [r["rows"] for r in t.recover_records().collect()] == [4] and t.recover_batches().count() == 4 and t.wal_tail().count() == 0


def test_reopen_with_active_rows(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", PV)
    t.append(ticks(spark))
    t.flush()
    t.append(ticks(spark, [(50, 5.0, 500)]))
    t = Table.open(spark, f"{tmp_path}/t", PV)
    assert (t.sealed_segment_count, t.row_count) == (1, 1)
    assert prices(t.scan_time_range(35, 60, ordered=True)) == [4.0, 5.0]
    with pytest.raises(SchemaError):
        Table.open(spark, f"{tmp_path}/t", TRADES)


def test_compaction(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", PV)
    for row in ROWS[:3]:
        t.append(ticks(spark, [row]))
        t.flush()
    assert t.compact([]) is None
    with pytest.raises(UnknownSegmentError, match="unknown segment ids"):
        t.compact([1, 99])
    assert t.compact([2, 1, 1]).id == 4 and t.manifest.next_segment_id == 5
    assert [(s.id, s.row_count) for s in t.manifest.sealed_segments] == [(4, 2), (3, 1)]
    assert sorted(os.listdir(f"{tmp_path}/t/segments")) == ["seg-000003", "seg-000004"]
    t = Table.open(spark, f"{tmp_path}/t", PV)
    assert prices(t.scan_time_range(0, 50, ordered=True)) == [1.0, 2.0, 3.0]
    assert [r["volume"] for r in t.scan_time_range(0, 30, ordered=True).collect()] == [100, 200]


def test_segments_apart_move_up(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", PV)
    for row in ROWS[:3]:
        t.append(ticks(spark, [row]))
        t.flush()
    t.compact([1, 3])
    assert prices(t.scan_time_range(0, 50, ordered=True)) == [1.0, 3.0, 2.0]
    t.append(ticks(spark, [(5, 9.0, 9)]))
    assert prices(t.scan_time_range(0, 50, ordered=True)) == [1.0, 3.0, 2.0, 9.0]


def test_bad_batches_leave_no_trace(spark, tmp_path):
    schema = TableSchema("s", [("timestamp", TIMESTAMP), ("symbol", fixed_str(4))])
    t = Table.open(spark, f"{tmp_path}/t", schema)
    one = "SELECT 1L timestamp, CAST('{}' AS BINARY) symbol"
    for df in (
        spark.sql(one.format("AAPL")).select("symbol", "timestamp"),
        spark.sql("SELECT 1L timestamp"),
        spark.sql("SELECT 1 timestamp, CAST('AAPL' AS BINARY) symbol"),
        spark.sql(one.format("AAP")),
        spark.sql("SELECT CAST(NULL AS BIGINT) timestamp, CAST('AAPL' AS BINARY) symbol"),
    ):
        with pytest.raises(BatchError):
            t.append(df)
    assert t.records == 0 and os.listdir(f"{tmp_path}/t/log") == []
    assert t.append(spark.sql(one.format("AAPL"))) == 1
    assert Table.open(spark, f"{tmp_path}/t", schema).scan_time_range(0, 9).count() == 1


def test_recovery(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", PV)
    t.append(ticks(spark))
    os.makedirs(f"{tmp_path}/t/log/rec-000001.tmp")  # a writer that died
    os.makedirs(f"{tmp_path}/t/segments/seg-000001")  # a segment that was never committed
    t = Table.open(spark, f"{tmp_path}/t", PV)
    assert t.records == 1 and t.sealed_segment_count == 0 and t.scan_time_range(0, 99).count() == 4
    t.flush()
    assert t.scan_time_range(0, 99).count() == 4
    os.makedirs(f"{tmp_path}/t/log/rec-000005")
    with pytest.raises(LogError):
        Table.open(spark, f"{tmp_path}/t", PV)


def test_pruning_reads_only_overlapping_segments(spark, tmp_path):
    t = Table.open(spark, f"{tmp_path}/t", TRADES)
    for i in range(4):
        t.append(trades(spark, 100, 100 * i))
        t.flush()
    df = t.scan_time_range(150, 250)
    assert df.count() == 100 and {f.split("/")[-2] for f in df.inputFiles()} == {"seg-000002", "seg-000003"}
    assert t.scan_time_range(400, 500).count() == 0 and t.scan_time_range(9, 9).columns == TRADES.names


def test_streaming_ingest(spark, tmp_path):
    trades(spark, 50).write.parquet(f"{tmp_path}/in")
    t = Table.open(spark, f"{tmp_path}/t", TRADES)
    stream = spark.readStream.schema(TRADES.spark()).parquet(f"{tmp_path}/in")
    ingest(stream, t, f"{tmp_path}/cp", flush_every=1).awaitTermination(120)
    assert t.scan_time_range(0, 1000).count() == 50 and t.sealed_segment_count == 1
    trades(spark, 25, 50).write.mode("append").parquet(f"{tmp_path}/in")
    ingest(stream, t, f"{tmp_path}/cp", flush_every=2).awaitTermination(120)
    assert t.scan_time_range(0, 1000).count() == 75


def test_generator(spark):
    df = trades(spark, 10_000).unionByName(trades(spark, 10_000, 10_000))
    assert df.where(RangePredicate("price", 100.0, 110.0).compile(TRADES)).count() == 2000
    assert {bytes(r[0]) for r in df.select("symbol").distinct().collect()} == {b"EURUSD  ", b"BTCUSD  "}
    assert df.agg(F.min("volume"), F.max("volume")).first()[:] == (1.0, 100.0)


def test_open_with_a_part_of_the_columns(spark, tmp_path):
    whole = TableSchema("t", [("ts", TIMESTAMP), ("price", F64), ("n", I64)])
    t = Table.open(spark, str(tmp_path / "t"), whole)
    for i in range(3):
        t.append(spark.createDataFrame([(10 * i + j, float(j), j) for j in range(3)], "ts long, price double, n long"))
        t.flush()
    part = TableSchema("t", [("n", I64), ("ts", TIMESTAMP)])
    p = Table.open(spark, t.path, part)
    assert p.scan_time_range(0, 11, ordered=True).collect() == [(0, 0), (1, 1), (2, 2), (0, 10)]
    with pytest.raises(SchemaError):
        p.append(spark.createDataFrame([(1, 50)], "n long, ts long"))
    p.compact([1, 2, 3])
    again = Table.open(spark, t.path, whole)
    assert [r["price"] for r in again.scan_time_range(0, 100, ordered=True).collect()] == [0.0, 1.0, 2.0] * 3  # nothing lost
    for bad in ([("ts", TIMESTAMP), ("other", F64)], [("ts", TIMESTAMP), ("n", F64)]):
        with pytest.raises(SchemaError):
            Table.open(spark, t.path, TableSchema("t", bad))


def test_compaction_keeps_the_order_of_segments(spark, tmp_path):
    t = Table.open(spark, str(tmp_path / "o"), TableSchema("t", [("ts", TIMESTAMP), ("n", I64)]))
    for i in range(4):
        t.append(spark.createDataFrame([(100 - i, 2 * i), (100 - i, 2 * i + 1)], "ts long, n long"))
        t.flush()
    t.compact([1, 3])
    order = [0, 1, 4, 5, 2, 3, 6, 7]
    assert [r["n"] for r in t.scan_time_range(0, 200, ordered=True).collect()] == order
    t.compact([2, 4, 5])
    assert [r["n"] for r in t.scan_time_range(0, 200, ordered=True).collect()] == order


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidemark.plans.lifecycle import _folder

    with pytest.raises(ValueError):
        _folder(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn")))
