"""Each registered query of the library against DuckDB on the smallest data."""

import duckdb
import pytest

from orbitlake import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    left = sorted(tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) else str(x) for x in r) for r in got.select(*columns).toPandas().astype(object).values.tolist())
    right = sorted(tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) else str(x) for x in r) for r in want[columns].astype(object).values.tolist())
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 * max(1, abs(y))) for x, y in zip(a, b, strict=True)), (a, b)
