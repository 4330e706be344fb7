import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark import doctor, session
from tidemark.__main__ import LOG, main
from tidemark.errors import BatchError, ConfigError, LogError
from tidemark.functions import devices
from tidemark.operators import rows
from tidemark.schema import F64, I64, TIMESTAMP, TableSchema, fixed_str
from tidemark.sources import batch, config, raw
from tidemark.streaming import bursts

SYM = TableSchema("ticks", [("timestamp", TIMESTAMP), ("price", F64), ("symbol", fixed_str(4))])
MAGIC = b"TEST"


def columns(first, n):
    return {"timestamp": list(range(first, first + n)), "price": [float(i) for i in range(n)], "symbol": [b"MSFT", b"AAPL"] * (n // 2)}


def test_flat_segments(spark, tmp_path):
    for i in range(3):
        raw.write_segment(f"{tmp_path}/seg-{i:06d}", SYM, i, columns(100 * i, 100))
    df = raw.read_segments(spark, str(tmp_path), SYM)
    assert df.count() == 300 and df.where("timestamp >= 150 AND timestamp < 160").count() == 10
    assert {bytes(r[0]) for r in df.select("symbol").distinct().collect()} == {b"MSFT", b"AAPL"}
    reader = raw._Reader(str(tmp_path), SYM)
    list(reader.pushFilters([raw.GreaterThanOrEqual(("timestamp",), 150), raw.LessThan(("timestamp",), 160)]))
    assert [p.folder[-6:] for p in reader.partitions()] == ["000001"]
    other = TableSchema("t", [("timestamp", TIMESTAMP), ("price", I64)])
    with pytest.raises(BatchError):
        raw._Reader(str(tmp_path), other).partitions()
    (tmp_path / "seg-000001" / "price.col").write_bytes(b"123")
    with pytest.raises(BatchError):
        raw._Reader(str(tmp_path), SYM).partitions()


def test_framed_log(spark, tmp_path):
    log = b"".join(raw.frame(i, p, MAGIC) for i, p in enumerate([b"one", b"two"]))
    assert raw.unframe(log, MAGIC) == [(0, b"one"), (1, b"two")] and raw.unframe(log + b"xx", MAGIC) == raw.unframe(log, MAGIC)
    for damaged in (log[:-1], log[:-1] + bytes([log[-1] ^ 1])):
        with pytest.raises(LogError):
            raw.unframe(damaged, MAGIC)
    got = columns(7, 4)
    assert raw.decode_payload(SYM, raw.encode_payload(SYM, got)) == got
    with pytest.raises(LogError):
        raw.decode_payload(TableSchema("t", [("timestamp", TIMESTAMP), ("symbol", fixed_str(4)), ("price", F64)]), raw.encode_payload(SYM, got))
    (tmp_path / "log").write_bytes(b"".join(raw.frame(i, raw.encode_payload(SYM, columns(10 * i, 4)), MAGIC) for i in range(3)))
    df = raw.read_log(spark, f"{tmp_path}/log", SYM, MAGIC, first=1)
    assert [(r["_rec"], r["timestamp"]) for r in df.orderBy("timestamp").collect()] == [(1, 10), (1, 11), (1, 12), (1, 13), (2, 20), (2, 21), (2, 22), (2, 23)]


def test_payload_bytes():
    schema = TableSchema("t", [("ts", TIMESTAMP), ("s", fixed_str(2))])
    raw_bytes = bytes.fromhex(
        "0200000000000000 0200000000000000"
        "02000000 7473 02 0200000000000000 0700000000000000 0800000000000000"
        "01000000 73 03 0200000000000000 0200000000000000 02000000 4142 02000000 4344".replace(" ", "")
    )
    assert raw.encode_payload(schema, {"ts": [7, 8], "s": [b"AB", b"CD"]}) == raw_bytes
    assert raw.decode_payload(schema, raw_bytes) == {"ts": [7, 8], "s": [b"AB", b"CD"]}
    with pytest.raises(LogError):
        raw.decode_payload(schema, raw_bytes[:-6] + b"\x01\0\0\0C")


def test_command_line(spark, tmp_path, capsys):
    assert main(["config", "default", "--output", f"{tmp_path}/c.toml"]) == 0 and main(["config", "validate", "--file", f"{tmp_path}/c.toml"]) == 0
    (tmp_path / "bad.toml").write_text("nope = 1")
    assert main(["config", "validate", "--file", f"{tmp_path}/bad.toml"]) == 1 and main(["config", "validate", "--file", f"{tmp_path}/none"]) == 1
    for _ in range(2):
        assert main(["bench", "--path", f"{tmp_path}/t", "--rows-per-batch", "100", "--batches", "2", "--scan-iterations", "1", "--compact", "--history", f"{tmp_path}/h"]) == 0
    out = capsys.readouterr().out
    assert "db_append: 200 rows" in out and "before:" in out


def test_doctor_and_exit_codes(tmp_path, capsys):
    (tmp_path / "meminfo").write_text("HugePages_Total:       4\nHugePages_Free:   3\nHugepagesize:    2048 kB\n")
    (tmp_path / "bus/pci/devices/0000:01:00.0").mkdir(parents=True)
    (tmp_path / "drivers/nvme").mkdir(parents=True)
    (tmp_path / "bus/pci/devices/0000:02:00.0").mkdir()
    (tmp_path / "bus/pci/devices/0000:02:00.0/driver").symlink_to(tmp_path / "drivers/nvme")
    found = {c.name: (c.state, c.detail) for c in doctor.checks(True, [str(tmp_path), f"{tmp_path}/no"], ["0000:01:00.0", "0000:02:00.0", "x", " "], str(tmp_path), str(tmp_path))}
    assert found["hugepages"] == ("ok", "total=4 free=3 size=2048 kB") and found["vfio"][0] == "warn"
    assert [found[k][0] for k in (f"folder {tmp_path}", f"folder {tmp_path}/no", "pci 0000:01:00.0", "pci 0000:02:00.0", "pci x")] == ["ok", "fail", "warn", "ok", "fail"]
    assert found["pci 0000:02:00.0"][1] == "driver=nvme"
    assert [doctor.checks(need, proc=f"{tmp_path}/no")[1].state for need in (False, True)] == ["warn", "fail"]
    assert main(["doctor"]) == 0 and main(["doctor", "--folder", f"{tmp_path}/no"]) == 2
    assert main(["bench", "--path", "x", "--backend", "spdk"]) == 3
    capsys.readouterr()
    assert main(["--trace-json", "config", "default"]) == 0
    LOG.info("phase", extra={"fields": {"units": 3}})
    assert json.loads(capsys.readouterr().err)["fields"] == {"units": 3}
    main(["config", "default"])


def test_bursts(spark, tmp_path):
    df = spark.createDataFrame([(0, b"abc"), (1, b"de"), (0, b"f")], "queue int, packet binary")
    assert {tuple(r) for r in bursts.send(df, f"{tmp_path}/b", 2).collect()} == {(0, 2, 4), (1, 1, 2)}
    for bad in (df.limit(0), df.withColumn("queue", F.lit(2))):
        with pytest.raises(Exception, match="empty|InvalidQueue"):
            bursts.send(bad, f"{tmp_path}/bad", 2)
    with pytest.raises(BatchError):
        bursts.receive(spark, f"{tmp_path}/b", 2, 2)
    q = bursts.receive(spark, f"{tmp_path}/b", 0, 2).writeStream.format("memory").queryName("burst").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(bytes(r["packet"]) for r in spark.table("burst").collect()) == [b"abc", b"f"]


def test_admission_without_queues(spark):
    asked = spark.createDataFrame([("namespace", 1, 0, 512), ("namespace", 1, 0, 0), ("namespace", None, 0, 512), (None, 1, 0, 512)], "kind string, nsid long, offset long, length long")
    spaces = spark.createDataFrame([(1, 512, 10, 4096)], "nsid long, sector_size long, capacity long, max_io_size long")
    got = devices.admit(asked, spaces, spark.createDataFrame([], "queue_id long")).select("error").collect()
    assert sorted(r[0] for r in got) == ["InvalidTarget", "NamespaceNotFound", "NoQueuePairs", "ZeroLength"]


def test_differences(spark):
    a = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 0.0)], "i long, x double")
    assert [r["i"] for r in rows.differences(a, a, "i").collect()] == [1]
    b = a.where("i <> 1").union(spark.createDataFrame([(4, 1.0)], a.schema))
    assert {(r["i"], r["columns"][0]) for r in rows.differences(a, b, "i").collect()} == {(1, "missing"), (4, "missing")}
    with pytest.raises(BatchError):
        rows.differences(a, a.withColumnRenamed("x", "y"), "i")


def test_sections(spark, tmp_path):
    c = config.parse('[dpdk]\nrx_queues = 4\n[db]\npath = "%s"\nsegment_rows = 3\n' % (tmp_path / "t"))
    assert c.sections["dpdk"]["rx_queues"] == 4 and c.sections["uring"]["sq_depth"] == 4096 and config.parse(config.to_toml(c)) == c
    for bad in ("[reactor]\npoll_cores = []", "[bufpool]\ncount = 0", "[dpdk]\npci_addr = ''", "[uring]\nnope = 1", "[spdk]\ndevices = [1]", "[uring]\nsq_depth = -1", "[db]\nnope = 1", "segment_rows = 1\n[db]\nsegment_rows = 2", "spdk = 1"):
        with pytest.raises(ConfigError):
            config.parse(bad)
    t = c.open(spark)
    rows_ = {"timestamp": [1, 2], "symbol": [b"EURUSD  "] * 2, "price": [1.0, 2.0], "volume": [1.0, 1.0]}
    t.append(batch.batch(spark, c.schema, rows_))
    assert t.seal_when(c.segment_rows) is None
    t.append(batch.batch(spark, c.schema, rows_))
    parts = t.recover_payloads().orderBy("_rec", "_part").collect()
    whole = [raw.decode_payload(c.schema, bytes(p["payload"])) for p in parts]
    assert {p["_rec"] for p in parts} == {0, 1} and sum((w["timestamp"] for w in whole), []) == [1, 2, 1, 2]
    assert t.seal_when(c.segment_rows).row_count == 4 and t.recover_payloads(most=1).count() == 4


def test_archive_imports(tmp_path):
    path = session.archive()
    code = "import tidemark.sources.table, tidemark; print(tidemark.__file__)"
    got = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": path}, cwd=tmp_path, capture_output=True, text=True)
    assert got.returncode == 0 and got.stdout.startswith(path)
