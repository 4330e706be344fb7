"""Scans, predicates, projections, gathering and segments over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import predicates as P, rows, scan
from ..schema import F64, I64, TIMESTAMP, TableSchema, fixed_str
from ..sources import history

SCHEMA = TableSchema("events", [("ns", TIMESTAMP), ("event_id", I64), ("user_id", I64), ("sym", fixed_str(8)), ("value", F64)])
DAY, NEXT_DAY = 1_704_412_800_000_000_000, 1_704_499_200_000_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `ns` (the time in nanoseconds) and `sym` (a FixedStr of 8 bytes) beside the raw `ts`."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("ts", scan.ns_of(F.col("ts")).alias("ns"), "event_id", "user_id", F.rpad("event_type", 8, " ").cast("binary").alias("sym"), "value")


def shown(df: DataFrame) -> DataFrame:
    """The columns that queries return; bytes as text."""
    return df.select("event_id", "ns", "user_id", F.col("sym").cast("string").alias("sym"), "value")


_SHOWN = "event_id, epoch_ns(ts) AS ns, user_id, rpad(event_type, 8, ' ') AS sym, value"
_DAY = f"epoch_ns(ts) >= {DAY} AND epoch_ns(ts) < {NEXT_DAY}"

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT {_SHOWN}, event_id // 1000 + 1 AS segment_id FROM events WHERE {_DAY}")
def scan_time_range(spark, sf_dir):
    df = events(spark, sf_dir)
    out = scan.scan_time_range(df, "ts", DAY, NEXT_DAY)
    return out.select(*shown(out).columns[:3], F.col("sym").cast("string").alias("sym"), "value", F.floor(F.col("event_id") / 1000).cast("long").alias("_s")).withColumn("segment_id", F.col("_s") + 1).drop("_s")


@query(f"SELECT {_SHOWN} FROM events WHERE {_DAY} AND value >= 10 AND value < 50 AND NOT isnan(value)")
def scan_where(spark, sf_dir):
    return shown(scan.scan_where(events(spark, sf_dir), "ts", DAY, NEXT_DAY, P.RangePredicate("value", 10.0, 50.0), SCHEMA))


@query(f"SELECT {_SHOWN} FROM events WHERE {_DAY}")
def time_range(spark, sf_dir):
    return shown(scan.scan_time_range(events(spark, sf_dir), "ts", DAY, NEXT_DAY))


@query(f"SELECT {_SHOWN} FROM events WHERE false")
def time_range_empty(spark, sf_dir):
    return shown(scan.scan_time_range(events(spark, sf_dir), "ts", DAY, DAY))


@query(f"SELECT {_SHOWN} FROM events WHERE ts < (SELECT max(ts) FROM events)")
def time_range_boundary(spark, sf_dir):
    df = events(spark, sf_dir)
    lo, hi = df.agg(F.min("ns"), F.max("ns")).first()
    return shown(scan.scan_time_range(df, "ts", lo, hi))


def _stats(spark, sf_dir) -> DataFrame:
    return rows.segment_stats(events(spark, sf_dir), F.floor(F.col("event_id") / 1000).cast("long") + 1, F.col("ns"))


_STATS = "SELECT event_id // 1000 + 1 AS segment_id, count(*) AS row_count, min(epoch_ns(ts)) AS min_ts, max(epoch_ns(ts)) AS max_ts FROM events GROUP BY 1"


@query(f"SELECT * FROM ({_STATS}) WHERE max_ts >= {DAY} AND min_ts < {NEXT_DAY}")
def segment_prune(spark, sf_dir):
    return rows.prune(_stats(spark, sf_dir), DAY, NEXT_DAY)


@query(_STATS)
def segment_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(f"SELECT count(*) AS row_count FROM events WHERE {_DAY}")
def scan_count(spark, sf_dir):
    return scan.scan_time_range(events(spark, sf_dir), "ts", DAY, NEXT_DAY).agg(F.count("*").alias("row_count"))


def _filtered(spark, sf_dir, predicate) -> DataFrame:
    return shown(events(spark, sf_dir).where(predicate.compile(SCHEMA)))


@query(f"SELECT {_SHOWN} FROM events WHERE value >= 10 AND value < 50 AND NOT isnan(value)")
def pred_range_f64(spark, sf_dir):
    return _filtered(spark, sf_dir, P.RangePredicate("value", 10.0, 50.0))


@query(f"SELECT {_SHOWN} FROM events WHERE value > 100.5::DOUBLE AND NOT isnan(value)")
def pred_gt_f64(spark, sf_dir):
    return _filtered(spark, sf_dir, P.GtPredicate("value", 100.5))


@query(f"SELECT {_SHOWN} FROM events WHERE user_id::DOUBLE >= 10.5::DOUBLE AND user_id::DOUBLE < 20::DOUBLE")
def pred_range_i64(spark, sf_dir):
    return _filtered(spark, sf_dir, P.RangePredicate("user_id", 10.5, 20.0))


@query(f"SELECT {_SHOWN} FROM events WHERE user_id::DOUBLE > 99.5::DOUBLE")
def pred_gt_i64(spark, sf_dir):
    return _filtered(spark, sf_dir, P.GtPredicate("user_id", 99.5))


@query(f"SELECT {_SHOWN} FROM events WHERE epoch_ns(ts)::DOUBLE >= 1.7053632e18::DOUBLE AND epoch_ns(ts)::DOUBLE < 1.7055e18::DOUBLE")
def pred_range_ts(spark, sf_dir):
    return _filtered(spark, sf_dir, P.RangePredicate("ns", 1.7053632e18, 1.7055e18))


@query(f"SELECT {_SHOWN} FROM events WHERE epoch_ns(ts)::DOUBLE > 1.7053632e18::DOUBLE")
def pred_gt_ts(spark, sf_dir):
    return _filtered(spark, sf_dir, P.GtPredicate("ns", 1.7053632e18))


@query(f"SELECT {_SHOWN} FROM events WHERE encode(rpad(event_type, 8, ' ')) = encode('click   ')")
def pred_scalar_eq(spark, sf_dir):
    return _filtered(spark, sf_dir, P.ScalarPredicate("sym", b"click   "))


@query(f"SELECT {_SHOWN} FROM events WHERE encode(rpad(event_type, 8, ' ')) = encode('click')")
def pred_scalar_unpadded(spark, sf_dir):
    return _filtered(spark, sf_dir, P.ScalarPredicate("sym", b"click"))


@query(f"SELECT {_SHOWN} FROM events WHERE false")
def pred_type_mismatch(spark, sf_dir):
    return _filtered(spark, sf_dir, P.RangePredicate("sym", 0.0, 1.0))


class EvenPredicate(P.ColumnPredicate):
    """Even longs, given as a column expression."""

    def to_column(self, c, dtype):
        return c % 2 == 0 if dtype.name == "I64" else F.lit(False)


@query(f"SELECT {_SHOWN} FROM events WHERE user_id % 2 = 0")
def pred_custom(spark, sf_dir):
    return _filtered(spark, sf_dir, EvenPredicate("user_id"))


class FractionPredicate(P.ColumnPredicate):
    """Values whose fraction is over a half, tested in Python batches."""

    def test(self, values):
        return values % 1 > 0.5


@query(f"SELECT {_SHOWN} FROM events WHERE value % 1 > 0.5::DOUBLE")
def pred_custom_batch(spark, sf_dir):
    return _filtered(spark, sf_dir, FractionPredicate("value"))


@query("SELECT value FROM events")
def project_column(spark, sf_dir):
    return scan.project(events(spark, sf_dir), "value")


@query(f"SELECT {_SHOWN} FROM events")
def project_schema_order(spark, sf_dir):
    from ..sources.batch import reorder

    return shown(reorder(events(spark, sf_dir).select("value", "sym", "ns", "user_id", "event_id"), SCHEMA))


_TAKE = [5, 3, 3, 9]


@query(f"SELECT i.pos AS _at, {_SHOWN} FROM events JOIN (VALUES (0::BIGINT, 5), (1, 3), (2, 3), (3, 9)) i(pos, id) ON event_id = i.id")
def take_indices(spark, sf_dir):
    df = rows.take_indices(shown(events(spark, sf_dir)), "event_id", _TAKE)
    return df


@query(f"SELECT {_SHOWN} FROM events WHERE event_id = 7")
def row_at(spark, sf_dir):
    return shown(rows.row_at(events(spark, sf_dir), "event_id", 7))


@query(f"SELECT {_SHOWN} FROM events")
def union_segments(spark, sf_dir):
    df = shown(events(spark, sf_dir))
    part = F.col("event_id") % 3
    return rows.union_segments([df.where(part == i) for i in range(3)])


@query("SELECT * FROM (VALUES (1::BIGINT), (2), (99)) r(segment_id) WHERE segment_id NOT IN (SELECT event_id // 1000 + 1 FROM events)")
def missing_segments(spark, sf_dir):
    return rows.missing_segments(spark, [1, 2, 99], _stats(spark, sf_dir).select("segment_id"))


@query("SELECT event_type AS benchmark, max(event_id) AS line_no, arg_max(value, event_id) AS rate_per_sec FROM events GROUP BY 1")
def history_latest(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("benchmark"), F.col("event_id").alias("line_no"), F.col("value").alias("rate_per_sec"))
    return history.latest(df, "benchmark", F.col("line_no"))


@query(
    """SELECT benchmark, line_no, rate_per_sec, previous,
  CASE WHEN abs(previous) <= 2.220446049250313e-16::DOUBLE THEN 0.0::DOUBLE ELSE (rate_per_sec - previous) / previous * 100::DOUBLE END AS delta_percent
FROM (SELECT event_type AS benchmark, event_id AS line_no, value AS rate_per_sec, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS previous FROM events)"""
)
def history_delta(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("benchmark"), F.col("event_id").alias("line_no"), F.col("value").alias("rate_per_sec"))
    return history.deltas(df, "benchmark", F.col("line_no"), "rate_per_sec")


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'user_id,value' ELSE 'user_id' END AS columns FROM events WHERE event_id % 13 = 0 OR event_id % 11 = 0 OR event_id % 17 = 0")
def rows_differ(spark, sf_dir):
    """Events against a copy of which some rows are changed or gone."""
    e = F.col("event_id")
    a = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    user, value = F.when((e % 11 == 0) | (e % 17 == 0), F.col("user_id") + 1).otherwise(F.col("user_id")), F.when(e % 11 == 0, F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value"))
    return rows.differences(a, a.select("event_id", user.alias("user_id"), value.alias("value")).where(e % 13 != 0), "event_id").withColumn("columns", F.array_join("columns", ","))
