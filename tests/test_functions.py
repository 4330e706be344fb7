import pytest
from pyspark.sql import functions as F

from tidemark.functions import packets as K, scalars as S
from tidemark.sources import history

FRAME = bytes.fromhex("000102030405060708090A0B0800" + "4500002000000000401100000A000001EF010203" + "04D22328000C0000" + "44415441")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_durations(spark):
    got = {t: one(spark, S.duration_ms(F.lit(t))) for t in ("500ms", "10s", "2m", "1h", "7", "bad", "", "-1s", "1d", "1 s")}
    assert got == {"500ms": 500, "10s": 10_000, "2m": 120_000, "1h": 3_600_000, "7": 7000, "bad": None, "": None, "-1s": None, "1d": None, "1 s": None}


def test_rates(spark):
    assert one(spark, S.rate(F.lit(10), F.lit(2.0))) == 5.0 and one(spark, S.rate(F.lit(1), F.lit(0.0))) == 1 / S.EPSILON
    assert one(spark, S.mib_per_sec(F.lit(1 << 20), F.lit(2.0))) == 0.5 and one(spark, S.mib_per_sec_of_record(F.lit(1 << 20), F.lit(0))) == 1000.0
    assert one(spark, S.percent_delta(F.lit(0.0), F.lit(5.0))) == 0.0 and one(spark, S.percent_delta(F.lit(4.0), F.lit(5.0))) == 25.0


def test_sizes_and_names(spark):
    assert [one(spark, S.round_up(F.lit(n), F.lit(2097152))) for n in (1, 2097152, 0)] == [2097152, 2097152, 0]
    assert one(spark, S.round_up(F.lit(1), F.lit(0))) is None
    assert one(spark, S.segment_name(F.lit(7))) == "seg-000007" and one(spark, S.segment_name(F.lit(1234567))) == "seg-1234567"
    assert one(spark, S.crc32(F.lit("123456789"))) == 0xCBF43926
    for v in (0, -1, 2**63 - 1, -(2**63), 258):
        assert one(spark, S.little_endian_long(F.lit(bytearray(v.to_bytes(8, "little", signed=True))))) == v
    assert one(spark, S.little_endian_long(F.lit(bytearray(b"123")))) is None
    text = F.lit("MemTotal: 5 kB\nHugePages_Total:    1024\nHugePages_Free:      900\nHugepagesize:       2048   kB\n")
    assert one(spark, S.meminfo_number(text, "HugePages_Total")) == 1024 and one(spark, S.meminfo_number(text, "Nope")) is None
    assert one(spark, S.meminfo_size(text, "Hugepagesize")) == "2048 kB"
    assert [one(spark, S.truthy(F.lit(t))) for t in (" YES ", "on", "0", "")] == [True, True, False, False]


@pytest.mark.parametrize("offset,length,want", [(1024, 1536, (None, 2, 3)), (1, 512, ("Unaligned", None, None)), (0, 513, ("Unaligned", None, None)), (0, 8192, ("TooLarge", None, None)), (4095 * 512, 1024, ("OutOfRange", None, None)), (1, 0, ("ZeroLength", None, None))])
def test_block_ranges(spark, offset, length, want):
    got = one(spark, S.lba_range(F.lit(offset), F.lit(length), F.lit(512), F.lit(4096), F.lit(4096)))
    assert (got["error"], got["lba"], got["count"]) == want


def test_multicast(spark):
    got = [one(spark, S.is_multicast(F.lit(ip), F.lit(p))) for ip, p in (("239.1.2.3", 9000), ("192.168.0.1", 9000), ("239.1.2.3", 0), ("224.0.0.1", 1), ("240.0.0.1", 1), ("x", 1))]
    assert got == [True, False, False, True, False, False]


def test_packets(spark):
    frame = lambda b: F.lit(bytearray(b))
    e, ip, u = (one(spark, f(frame(FRAME))) for f in (K.ethernet, K.ipv4, K.udp))
    assert (e["destination"], e["source"], e["ethertype"], e["kind"]) == ("00:01:02:03:04:05", "06:07:08:09:0a:0b", 0x0800, "Ipv4")
    assert (ip["header_len"], ip["protocol"], ip["src"], ip["dst"]) == (20, 17, "10.0.0.1", "239.1.2.3")
    assert (u["src_port"], u["dst_port"], u["length"]) == (1234, 9000, 12)
    assert bytes(one(spark, K.udp_payload(frame(FRAME)))) == b"DATA"
    assert one(spark, K.in_group(frame(FRAME), "239.1.2.3", 9000)) and not one(spark, K.in_group(frame(FRAME), "239.1.2.4", 9000))
    assert one(spark, K.ethernet(frame(bytes(13)))) is None and one(spark, K.ethernet(frame(bytes(20))))["kind"] == "Other"
    for broken in (bytes(20), FRAME[:33], FRAME[:14] + b"\x65" + FRAME[15:], FRAME[:14] + b"\x44" + FRAME[15:], FRAME[:14] + b"\x4f" + FRAME[15:40], FRAME[:12] + b"\x86\xdd" + FRAME[14:]):
        assert one(spark, K.ipv4(frame(broken))) is None
    for broken in (FRAME[:41], FRAME[:23] + b"\x06" + FRAME[24:]):
        assert one(spark, K.udp(frame(broken))) is None and one(spark, K.udp_payload(frame(broken))) is None
    options = FRAME[:14] + b"\x46" + FRAME[15:34] + b"\0\0\0\0" + FRAME[34:] + b"pad"
    assert one(spark, K.udp(frame(options)))["dst_port"] == 9000 and bytes(one(spark, K.udp_payload(frame(options)))) == b"DATApad"
    assert one(spark, K.ethernet(F.lit(None).cast("binary"))) is None


def test_history(spark, tmp_path):
    rows = [("scan", 10.0), ("append", 3.0), ("scan", 15.0)]
    for i, (name, rate) in enumerate(rows):
        df = spark.createDataFrame([(name, "rows", 1, None, 5, rate, None, [("k", i)], i)], history.SCHEMA)
        history.append_history(df, f"{tmp_path}/h")
    df = history.read_history(spark, f"{tmp_path}/h")
    last = {r["benchmark"]: r["rate_per_sec"] for r in history.latest(df, "benchmark", F.col("timestamp_ms")).collect()}
    assert last == {"scan": 15.0, "append": 3.0}
    d = {(r["benchmark"], r["timestamp_ms"]): r["delta_percent"] for r in history.deltas(df, "benchmark", F.col("timestamp_ms"), "rate_per_sec").collect()}
    assert d == {("scan", 0): None, ("append", 1): None, ("scan", 2): 50.0}
    (tmp_path / "bad.json").write_text('{"benchmark": "x"}\nnot json\n')
    with pytest.raises(Exception):
        history.read_history(spark, str(tmp_path / "bad.json")).collect()
