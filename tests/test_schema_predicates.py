import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import BatchError, ConfigError, SchemaError, UnknownColumnError
from tidemark.operators import predicates as P, rows, scan
from tidemark.schema import F64, I64, TIMESTAMP, ColumnDef, DType, TableSchema, fixed_str
from tidemark.sources import config
from tidemark.sources.batch import batch, reorder

TICKS = TableSchema("ticks", [("timestamp", TIMESTAMP), ("price", F64), ("volume", I64), ("symbol", fixed_str(4))])


def test_schema_rules():
    for columns in ([], [("a", F64)], [("a", TIMESTAMP), ("b", TIMESTAMP)], [("t", TIMESTAMP), ("t", F64)]):
        with pytest.raises(SchemaError):
            TableSchema("x", columns)
    with pytest.raises(SchemaError):
        TableSchema("", [("t", TIMESTAMP)])
    for name in ("", "a/b", "a\\b", "..", "_rec"):
        with pytest.raises(SchemaError):
            ColumnDef(name, F64)
    with pytest.raises(SchemaError):
        fixed_str(0)
    with pytest.raises(SchemaError):
        DType("U8")
    assert TICKS.time_column == "timestamp" and TICKS.column_index("volume") == 2 and TICKS.column("x") is None
    assert TableSchema.from_json(TICKS.to_json()) == TICKS
    assert TICKS.column_bytes(10) == {"timestamp": 80, "price": 80, "volume": 80, "symbol": 40}
    assert not any(f.nullable for f in TICKS.spark().fields) and TICKS.spark()["symbol"].metadata == {"dtype": "FixedStr", "width": 4}


def test_batches(spark):
    ok = {"price": [10.0, 11.0], "timestamp": [1, 2], "symbol": [b"MSFT", b"AAPL"], "volume": [1, 2]}
    df = batch(spark, TICKS, ok)
    assert df.columns == TICKS.names and df.count() == 2
    for change in ({"price": [1.0]}, {"price": [1, 2]}, {"volume": [True, 2]}, {"symbol": [b"MSF", b"AAPL"]}, {"symbol": ["MSFT", b"AAPL"]}, {"extra": [1, 2]}):
        with pytest.raises(BatchError):
            batch(spark, TICKS, ok | change)
    with pytest.raises(BatchError):
        batch(spark, TICKS, {k: v for k, v in ok.items() if k != "price"})
    assert reorder(df.select("symbol", "volume", "timestamp", "price"), TICKS).columns == TICKS.names
    with pytest.raises(BatchError):
        reorder(df.drop("price"), TICKS)


EDGE = [0.0, -0.0, 1.0, -1.5, math.nan, math.inf, -math.inf, 2.0**53, 2.0**53 + 2, 4.5, 1e300]
LONGS = [0, 1, -1, 2**53 - 1, 2**53, 2**53 + 1, 2**63 - 1, -(2**63), 1_705_363_200_000_000_001, 5]


def ieee(kind, v, *bounds):
    v = float(v)
    return bounds[0] <= v < bounds[1] if kind == "range" else v > bounds[0]


def test_predicates_follow_ieee(spark):
    r = random.Random(11)
    n = 60
    rows_ = [(i, r.choice(EDGE), r.choice(LONGS), b"AAPL" if i % 2 else b"MSFT") for i in range(n)]
    df = spark.createDataFrame(rows_, TICKS.spark()).cache()
    bounds = EDGE + [float(x) for x in LONGS] + [0.5, -0.5, 2.0**53 - 0.5]
    checks, want = [], []
    for _ in range(60):
        lo, hi, column = r.choice(bounds), r.choice(bounds), r.choice(["price", "volume", "timestamp"])
        at = {"timestamp": 0, "price": 1, "volume": 2}[column]
        for kind, p, b in (("range", P.RangePredicate(column, lo, hi), (lo, hi)), ("gt", P.GtPredicate(column, lo), (lo,))):
            checks.append(F.sum(p.compile(TICKS).cast("int")))
            want.append(sum(ieee(kind, x[at], *b) for x in rows_))
    got = [v or 0 for v in df.agg(*checks).first()]
    assert got == want


def test_other_predicates(spark):
    df = spark.createDataFrame([(10, 1.5, 1, b"MSFT"), (20, 2.5, 2, b"AAPL")], TICKS.spark())
    n = lambda p: df.where(p.compile(TICKS)).count()
    assert n(P.ScalarPredicate("symbol", b"AAPL")) == 1 and n(P.ScalarPredicate("symbol", b"AAP")) == 0
    assert n(P.RangePredicate("symbol", 0, 9)) == n(P.GtPredicate("symbol", 0)) == n(P.ScalarPredicate("price", b"x")) == 0
    with pytest.raises(UnknownColumnError):
        P.GtPredicate("nope", 1).compile(TICKS)

    class Hook(P.ColumnPredicate):
        def f64_gt(self):
            return 2.0

        def to_column(self, c, dtype):
            return F.lit(True)

    assert n(Hook("price")) == 1 and n(Hook("volume")) == 2  # hooks count for F64 columns only
    assert n(P.ColumnPredicate("price")) == 0


def test_bounds_reach_the_scan(spark, tmp_path, request):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.maxMetadataStringLength"))
    from tidemark.plans.events import SCHEMA, events

    spark.sql("SELECT TIMESTAMP_NTZ'2024-01-05 10:00:00' ts, 1L event_id, 2L user_id, 'click' event_type, 3.5D value").write.parquet(f"{tmp_path}/events.parquet")
    df = scan.scan_where(events(spark, str(tmp_path)), "ts", 1_704_412_800_000_000_001, 1_704_499_200_000_000_000, P.RangePredicate("user_id", 1.5, 9), SCHEMA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("GreaterThanOrEqual(ts,2024-01-05T00:00:00.000001", "LessThan(ts,2024-01-06", "GreaterThanOrEqual(user_id,2)", "LessThan(user_id,9)"))
    assert df.count() == 1


def test_time_ranges(spark):
    df = spark.createDataFrame([(10,), (20,), (30,), (40,)], "t long")
    n = lambda a, b: scan.scan_time_range(df, "t", a, b).count()
    assert (n(15, 35), n(10, 40), n(20, 20), n(30, 20), n(-(2**63), 2**63 - 1)) == (2, 3, 0, 0, 4)
    ntz = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' t")
    base = 1_704_067_200_000_000_000
    m = lambda a, b: scan.scan_time_range(ntz, "t", a, b).count()
    assert (m(base + 1000, base + 1001), m(base + 1001, base + 2000), m(base, base + 1000), m(-(2**63), 2**63 - 1)) == (1, 0, 0, 1)
    assert scan.scan_time_range(ntz, "t", 5, 5).columns == ["t"]
    with pytest.raises(UnknownColumnError):
        scan.scan_time_range(df, "x", 0, 1)
    with pytest.raises(UnknownColumnError):
        scan.project(df, "x")


def test_values_and_gather(spark):
    df = spark.createDataFrame([(10, 1.5, 1, b"MSFT"), (20, 2.5, 2, b"AAPL")], TICKS.spark())
    assert scan.values(df, "timestamp", TICKS, "I64") == [10, 20] and scan.values(df, "symbol", TICKS, "FixedStr") == [b"MSFT", b"AAPL"]
    with pytest.raises(TypeError):
        scan.values(df, "price", TICKS, "I64")
    got = rows.take_indices(df, "timestamp", [20, 10, 20]).orderBy("_at").collect()
    assert [r["timestamp"] for r in got] == [20, 10, 20]
    with pytest.raises(BatchError):
        rows.union_segments([df, df.select("price", "timestamp", "volume", "symbol")])
    stats = rows.segment_stats(df, F.col("volume"), F.col("timestamp"))
    assert rows.prune(stats, 10, 20).count() == 1 and rows.prune(stats, 10, 21).count() == 2 and rows.prune(stats, 20, 20).count() == 0
    assert [r[0] for r in rows.missing_segments(spark, [1, 2, 99, 99], stats.select("segment_id")).collect()] == [99]


def test_config():
    c = config.Config()
    assert config.parse(config.to_toml(c)) == c
    made = config.parse('segment_rows = 5\n[schema]\nname = "t"\n[[schema.columns]]\nname = "ts"\ndtype = "Timestamp"\n[[schema.columns]]\nname = "s"\ndtype = { FixedStr = 4 }')
    assert made.segment_rows == 5 and made.schema.column("s").dtype == fixed_str(4)
    for bad in ("segment_rows = 0", "nope = 1", "data_dir = ''", "segment_rows = true", "[schema]\nname = 't'", "[schema]\nname = 't'\n[[schema.columns]]\nname = 'a'\ndtype = 'U8'", "x ="):
        with pytest.raises(ConfigError):
            config.parse(bad)
