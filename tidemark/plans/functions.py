"""Scalar functions and packet headers, with inputs made from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import devices as D, packets as K, scalars as S
from ..streaming import bursts

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


_EPS = "2.220446049250313e-16::DOUBLE"


@query(f"SELECT event_id, event_id::DOUBLE / greatest((user_id % 5)::DOUBLE, {_EPS}) AS rate FROM events")
def fn_rate(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.rate(F.col("event_id"), F.col("user_id") % 5).alias("rate"))


@query(f"SELECT event_id, (event_id * 4096)::DOUBLE / 1048576::DOUBLE / greatest((user_id % 5)::DOUBLE, {_EPS}) AS mib FROM events")
def fn_mib_per_sec(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.mib_per_sec(F.col("event_id") * 4096, F.col("user_id") % 5).alias("mib"))


@query(
    """SELECT event_id, event_id::VARCHAR || CASE event_id % 6 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' WHEN 4 THEN '' ELSE 'x' END AS duration,
  event_id * CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 WHEN 3 THEN 3600000 WHEN 4 THEN 1000 END::BIGINT AS ms FROM events"""
)
def fn_parse_duration(spark, sf_dir):
    k = F.col("event_id") % 6
    text = F.concat(F.col("event_id").cast("string"), F.when(k == 0, "ms").when(k == 1, "s").when(k == 2, "m").when(k == 3, "h").when(k == 4, "").otherwise("x"))
    return _events(spark, sf_dir).select("event_id", text.alias("duration"), S.duration_ms(text).alias("ms"))


@query("SELECT event_id, printf('seg-%06d', event_id) AS segment FROM events")
def fn_segment_name(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.segment_name(F.col("event_id")).alias("segment"))


@query("SELECT event_id, event_id * CASE WHEN user_id % 2 = 0 THEN 8 ELSE 4 END AS bytes FROM events")
def fn_column_bytes(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.column_bytes(F.col("event_id"), F.when(F.col("user_id") % 2 == 0, 8).otherwise(4)).alias("bytes"))


@query("SELECT event_id, CASE WHEN user_id % 4 > 0 THEN (event_id + user_id % 4 * 512 - 1) // (user_id % 4 * 512) * (user_id % 4 * 512) END AS rounded FROM events")
def fn_round_up(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.round_up(F.col("event_id"), F.col("user_id") % 4 * 512).alias("rounded"))


@query("SELECT event_id, (user_id % 256)::VARCHAR || '.1.2.3' AS ip, event_id % 3 AS port, user_id % 256 BETWEEN 224 AND 239 AND event_id % 3 <> 0 AS multicast FROM events")
def fn_is_multicast(spark, sf_dir):
    ip, port = F.concat((F.col("user_id") % 256).cast("string"), F.lit(".1.2.3")), F.col("event_id") % 3
    return _events(spark, sf_dir).select("event_id", ip.alias("ip"), port.alias("port"), S.is_multicast(ip, port).alias("multicast"))


@query(
    """WITH x AS (SELECT event_id, event_id * 256 AS o, (user_id % 20) * 512 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS n FROM events),
e AS (SELECT *, CASE WHEN n = 0 THEN 'ZeroLength' WHEN n > 8192 THEN 'TooLarge' WHEN o % 512 <> 0 THEN 'Unaligned' WHEN n % 512 <> 0 THEN 'Unaligned' WHEN o // 512 + n // 512 > 4096 THEN 'OutOfRange' END AS error FROM x)
SELECT event_id, error, CASE WHEN error IS NULL THEN o // 512 END AS lba, CASE WHEN error IS NULL THEN n // 512 END AS blocks FROM e"""
)
def fn_lba_range(spark, sf_dir):
    o = F.col("event_id") * 256
    n = (F.col("user_id") % 20) * 512 + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    got = S.lba_range(o, n, F.lit(512), F.lit(4096), F.lit(8192))
    return _events(spark, sf_dir).select("event_id", got.alias("r")).select("event_id", "r.error", "r.lba", F.col("r.count").alias("blocks"))


@query("SELECT event_id, lower(trim(flag, ' ' || chr(9) || chr(10) || chr(8195))) IN ('1', 'true', 'yes', 'on') AS yes FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'on' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN 'TRUE' WHEN 5 THEN chr(9) || 'on' || chr(10) WHEN 6 THEN chr(8195) || 'yes' ELSE '' END AS flag FROM events)")
def fn_truthy(spark, sf_dir):
    flags = [" Yes ", "on", "1", "no", "TRUE", "\ton\n", "\u2003yes", ""]
    flag = F.element_at(F.array(*map(F.lit, flags)), (F.col("event_id") % 8 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", S.truthy(flag).alias("yes"))


@query(
    """SELECT event_id, CASE WHEN user_id % 4 < 2 THEN event_id END AS pages, CASE WHEN user_id % 4 < 2 THEN NULL WHEN user_id % 4 = 2 THEN user_id END AS free FROM events"""
)
def fn_meminfo(spark, sf_dir):
    k, e, u = F.col("user_id") % 4, F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = F.concat(F.lit("Other: 1 kB\nPages: "), F.when(k == 0, e).when(k == 1, F.concat(e, F.lit(" kB"))).otherwise(F.concat(F.lit("x"), e)), F.lit("\nFree:"), F.when(k == 2, F.concat(F.lit("  +"), u)).when(k == 3, F.concat(F.lit(" -"), u)).otherwise(""), F.lit("\nLast: 7"))
    return _events(spark, sf_dir).select("event_id", S.meminfo_number(text, "Pages").alias("pages"), S.meminfo_number(text, "Free").alias("free"))


def _bytes(value: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    h = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)]))


@query("SELECT event_id, user_id * 4294967296 - event_id * 7919 AS value, CASE WHEN event_id % 2 = 0 THEN user_id * 4294967296 - event_id * 7919 END AS read FROM events")
def fn_le_long(spark, sf_dir):
    value = F.col("user_id") * 4294967296 - F.col("event_id") * 7919
    data = F.when(F.col("event_id") % 2 == 0, _bytes(value)).otherwise(F.unhex(F.lit("01")))
    return _events(spark, sf_dir).select("event_id", value.alias("value"), S.little_endian_long(data).alias("read"))


@query("SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * (1 + (user_id % 1024) / 1024::DOUBLE) * pow(2, (event_id % 200 - 100)::DOUBLE) AS read FROM events")
def fn_le_double(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    bits = F.when(e % 3 == 0, F.lit(-(1 << 63))).otherwise(F.lit(0)) + F.shiftleft(e % 200 + 923, 52) + F.shiftleft(u % 1024, 42)
    return _events(spark, sf_dir).select("event_id", S.little_endian_double(_bytes(bits)).alias("read"))


_CRC = """WITH b AS (SELECT i, i AS c0 FROM range(256) r(i)),
"""
_CRC += "".join(f"t{k} AS (SELECT i, CASE WHEN c{k} & 1 = 1 THEN xor(3988292384, c{k} >> 1) ELSE c{k} >> 1 END AS c{k + 1} FROM {'b' if k == 0 else f't{k - 1}'}),\n" for k in range(8))
_CRC += """t AS (SELECT list(c8 ORDER BY i) AS t FROM t7),
x0 AS (SELECT event_id, rpad(event_type, 8, ' ') AS sym, 4294967295::BIGINT AS c FROM events),
"""
_CRC += "".join(f"x{k} AS (SELECT event_id, sym, xor(t[(xor(c, ascii(substr(sym, {k}, 1))) & 255) + 1], c >> 8) AS c FROM x{k - 1}, t),\n" for k in range(1, 9))
_CRC += "y AS (SELECT event_id, sym, xor(c, 4294967295) AS crc32 FROM x8) SELECT event_id, sym, crc32 FROM y"


@query(_CRC)
def crc32(spark, sf_dir):
    sym = F.rpad("event_type", 8, " ")
    return _events(spark, sf_dir).select("event_id", sym.alias("sym"), S.crc32(sym).alias("crc32"))


def frames(spark, sf_dir) -> DataFrame:
    """A frame for each event: UDP, TCP, ARP or cut short, by event_id mod 7."""
    u, k = F.col("user_id"), F.col("event_id") % 7
    h4 = lambda c: F.lpad(F.hex(c), 4, "0")
    kind = F.when(k == 5, "0806").otherwise("0800")
    protocol = F.when(k == 4, "06").otherwise("11")
    ip = F.concat(F.lit("450000200000000040"), protocol, F.lit("0000"), F.lit("0A00"), h4(u % 65536), F.when(u % 2 == 0, "EF010203").otherwise("C0A80001"))
    udp = F.concat(h4(u % 65536), F.when(u % 3 == 0, "2328").otherwise("2329"), F.lit("000C0000"))
    whole = F.concat(F.lit("000102030405060708090A0B"), kind, ip, udp, F.hex(F.lit("DATA")))
    size = F.when(k == 0, 13).when(k == 1, 20).when(k == 2, 38).otherwise(46)
    text = F.substring(whole, F.lit(1), size * 2)
    return _events(spark, sf_dir).select("event_id", F.unhex(text).alias("frame"))


_FRAMES = """WITH f AS (SELECT event_id, substr('000102030405060708090A0B' || CASE WHEN event_id % 7 = 5 THEN '0806' ELSE '0800' END || '450000200000000040'
  || CASE WHEN event_id % 7 = 4 THEN '06' ELSE '11' END || '0000' || '0A00' || printf('%04X', user_id % 65536) || CASE WHEN user_id % 2 = 0 THEN 'EF010203' ELSE 'C0A80001' END
  || printf('%04X', user_id % 65536) || CASE WHEN user_id % 3 = 0 THEN '2328' ELSE '2329' END || '000C0000' || '44415441',
  1, 2 * CASE event_id % 7 WHEN 0 THEN 13 WHEN 1 THEN 20 WHEN 2 THEN 38 ELSE 46 END) AS h FROM events),
g AS (SELECT event_id, h, len(h) // 2 AS n, len(h) >= 28 AS eth, len(h) >= 68 AND substr(h, 25, 4) = '0800' AS ip FROM f),
x AS (SELECT *, ip AND substr(h, 47, 2) = '11' AND n >= 42 AS udp FROM g)
"""
_NUM = "('0x' || substr(h, {}, {}))::INT"
_IP = " || '.' || ".join("('0x' || substr(h, {}, 2))::INT".format(f"{{0}} + {2 * i}") for i in range(4))


@query(_FRAMES + f"SELECT event_id, CASE WHEN eth THEN {_NUM.format(25, 4)} END AS ethertype, CASE WHEN eth THEN CASE substr(h, 25, 4) WHEN '0800' THEN 'Ipv4' WHEN '0806' THEN 'Arp' ELSE 'Other' END END AS kind, CASE WHEN eth THEN '06:07:08:09:0a:0b' END AS source FROM x")
def pkt_ethertype(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", K.ethernet(F.col("frame")).alias("e")).select("event_id", "e.ethertype", "e.kind", "e.source")


@query(_FRAMES + f"SELECT event_id, CASE WHEN ip THEN 20 END AS header_len, CASE WHEN ip THEN {_NUM.format(47, 2)} END AS protocol, CASE WHEN ip THEN {_IP.format(53)} END AS src, CASE WHEN ip THEN {_IP.format(61)} END AS dst FROM x")
def pkt_ipv4(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", K.ipv4(F.col("frame")).alias("p")).select("event_id", "p.header_len", "p.protocol", "p.src", "p.dst")


@query(_FRAMES + f"SELECT event_id, CASE WHEN udp THEN {_NUM.format(69, 4)} END AS src_port, CASE WHEN udp THEN {_NUM.format(73, 4)} END AS dst_port, CASE WHEN udp THEN {_NUM.format(77, 4)} END AS length FROM x")
def pkt_udp(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", K.udp(F.col("frame")).alias("u")).select("event_id", "u.src_port", "u.dst_port", "u.length")


@query(_FRAMES + "SELECT event_id, CASE WHEN udp THEN substr(h, 85) END AS payload FROM x")
def pkt_payload(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", F.hex(K.udp_payload(F.col("frame"))).alias("payload"))


@query(_FRAMES + "SELECT event_id, n AS bytes FROM x WHERE udp")
def pkt_udp_only(spark, sf_dir):
    return frames(spark, sf_dir).where(K.is_udp(F.col("frame"))).select("event_id", F.octet_length("frame").cast("long").alias("bytes"))


@query(_FRAMES + "SELECT event_id FROM x WHERE udp AND substr(h, 61, 8) = 'EF010203' AND substr(h, 73, 4) = '2328'")
def pkt_multicast_filter(spark, sf_dir):
    return frames(spark, sf_dir).where(K.in_group(F.col("frame"), "239.1.2.3", 9000)).select("event_id")


@query(
    """WITH r AS (SELECT event_id, event_id % 10 = 0 AS port, user_id % 5 AS nsid, event_id % 300 * 256 AS o, (user_id % 20) * 512 AS n FROM events),
s AS (SELECT * FROM (VALUES (1, 512, 100, 8192), (2, 256, 400, 4096), (3, 512, 4096, 65536)) v(nsid, sector, capacity, most)),
e AS (SELECT r.*, sector, CASE WHEN port THEN 'InvalidTarget' WHEN sector IS NULL THEN 'NamespaceNotFound' WHEN n = 0 THEN 'ZeroLength' WHEN n > most THEN 'TooLarge'
  WHEN o % sector <> 0 OR n % sector <> 0 THEN 'Unaligned' WHEN o // sector + n // sector > capacity THEN 'OutOfRange' END AS error FROM r LEFT JOIN s ON s.nsid = r.nsid)
SELECT event_id, nsid, error, CASE WHEN error IS NULL THEN o // sector END AS lba, CASE WHEN error IS NULL THEN n // sector END AS blocks, CASE WHEN error IS NULL THEN 4::BIGINT END AS queue FROM e"""
)
def io_admission(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    asked = _events(spark, sf_dir).select("event_id", F.when(e % 10 == 0, "port").otherwise("namespace").alias("kind"), (u % 5).alias("nsid"), (e % 300 * 256).alias("offset"), (u % 20 * 512).alias("length"))
    spaces = spark.createDataFrame([(1, 512, 100, 8192), (2, 256, 400, 4096), (3, 512, 4096, 65536)], "nsid long, sector_size long, capacity long, max_io_size long")
    got = D.admit(asked, spaces, spark.createDataFrame([(7,), (4,)], "queue_id long"))
    return got.select("event_id", "nsid", "error", "lba", F.col("count").alias("blocks"), "queue")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'nsid' WHEN user_id % 3 = 0 THEN 'sector_size' WHEN user_id % 5 = 0 THEN 'capacity' WHEN event_id % 7 = 0 THEN 'max_io_size' END AS error FROM events")
def fn_namespace_error(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return _events(spark, sf_dir).select("event_id", D.namespace_error(e % 4, u % 3, u % 5, e % 7).alias("error"))


@query("SELECT event_id, CASE WHEN user_id % 6 >= 4 THEN 'InvalidQueue' END AS queue, CASE WHEN event_id % 3 = 0 THEN 'InvalidTarget' WHEN user_id % 2 = 1 THEN 'PortMismatch' END AS port FROM events")
def fn_queue_error(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 != 0, "port")
    return _events(spark, sf_dir).select("event_id", D.queue_error(F.col("user_id") % 6, F.lit(4)).alias("queue"), D.port_error(kind, F.col("user_id") % 2, F.lit(0)).alias("port"))


@query(_FRAMES + "SELECT (event_id % 4)::INT AS queue, count(*) AS packets, sum(n)::BIGINT AS bytes FROM x GROUP BY 1")
def pkt_sent(spark, sf_dir):
    return bursts.sent(frames(spark, sf_dir).select((F.col("event_id") % 4).cast("int").alias("queue"), F.col("frame").alias("packet")))
