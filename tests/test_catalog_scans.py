"""Every query of the ordered scans and of the overviews equals its SQL."""

import duckdb
import pytest

from netloom.plans import catalog_overview, catalog_scans
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem", "nation", "orders", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


QUERIES = catalog_scans.queries() | catalog_overview.queries()
SQL = catalog_scans.oracle_sql() | catalog_overview.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    plain = lambda v: float(f"{v:.8g}") if isinstance(v, float) else v
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in cursor.fetchall()), key=repr)
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr) == want
