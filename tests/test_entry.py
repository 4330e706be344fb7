import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


def norm(rows):
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=str)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["event_id", "ns", "user_id", "sym", "value"]


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"])
def test_query_matches_sql(spark, db, name):
    got, want = entry.queries()[name](spark, SF), db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert norm(got.select(columns).collect()) == norm(want.select(", ".join(columns)).fetchall())
