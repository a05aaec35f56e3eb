"""The reads against their SQL at the smallest tables, and odd values."""

import duckdb
import pytest

from netloom.operators import reads
from netloom.plans import catalog_reads
from pyspark.sql import functions as F

from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [*catalog_reads.queries()])
def test_read_equals_sql(spark, duck, name):
    got = catalog_reads.queries()[name](spark, SF)
    want = duck.sql(catalog_reads.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pick = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    mine = pick(got.select(*columns).collect())
    assert mine and mine == pick(want.select(*columns).fetchall())


def test_odd_addresses_and_codes(spark):
    ips = {"10.1.2.3": "private", "172.31.0.1": "private", "172.32.0.1": "public", "127.0.0.1": "loopback", "169.254.1.1": "link_local", "224.0.0.1": "multicast", "255.1.1.1": "reserved", "1.2.3": "invalid", "1.2.3.999": "invalid", "": "invalid", "a.b.c.d": "invalid", None: None}
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    assert {r.ip: r.k for r in df.select("ip", reads.address_class(F.col("ip")).alias("k")).collect()} == ips
    df = spark.createDataFrame([(771,), (1,), (None,)], "c int")
    assert [r.n for r in df.select(reads.code_name(F.col("c"), reads.TLS_VERSIONS).alias("n")).collect()] == ["TLS 1.2", "1", None]
