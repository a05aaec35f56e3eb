"""Traffic, DNS, TLS and lateral operators on literal rows and thresholds."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from netloom.functions import scalar as S
from netloom.operators import dns, lateral, traffic
from netloom.operators.windows import bucketed_range_join, ip_range_join, suffix_join
from netloom.plans import catalog
from tests.conftest import SF

PACKETS = "packet_id long, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size int, ttl int, dns_query string, dns_type string"


def beacon(n, step, src="10.0.0.1"):
    return [(i, 1000.0 + i * step, src, "203.0.0.9", 40000, 443, "TLS", 100, 64, None, None) for i in range(n)]


@pytest.mark.parametrize(("n", "found"), [(4, 0), (5, 1), (60, 1)])
def test_beacons_need_five_points(spark, n, found):
    rows = traffic.detect_beacons(spark.createDataFrame(beacon(n, 60.0), PACKETS)).collect()
    assert len(rows) == found
    if found:
        r = rows[0]
        assert (r.confidence, r.beacon_type, r.interval_mean, r.regularity, r.packet_count) == ("HIGH", "medium_beacon", 60.0, 1.0, n)


def test_unrelated_rows_and_partitions_change_nothing(spark):
    a = spark.createDataFrame(beacon(30, 60.0), PACKETS)
    b = spark.createDataFrame([(1000 + i, 5000.0 + i**2, "10.9.9.9", "1.1.1.1", 5, 80, "TCP", 60, 128, None, None) for i in range(20)], PACKETS)
    want = traffic.detect_beacons(a).collect()
    for n in (1, 7):
        assert [r for r in traffic.detect_beacons(a.unionAll(b).repartition(n)).collect() if r.src_ip == "10.0.0.1"] == want


def test_flow_direction_and_timeout(spark):
    rows = [(1, 10.0, "b", "a", 2, 1, "TCP", 5, 64, None, None), (2, 11.0, "a", "b", 1, 2, "TCP", 7, 64, None, None), (3, 500.0, "a", "b", 1, 2, "TCP", 1, 64, None, None)]
    p = spark.createDataFrame(rows, PACKETS)
    (f,) = traffic.aggregate_flows(p).collect()
    assert (f.src_ip, f.dst_ip, f.packet_count, f.total_bytes, f.session_duration) == ("b", "a", 3, 13, 490.0)
    assert sorted(r.packet_count for r in traffic.aggregate_flows(p, 120.0).collect()) == [1, 2]


def test_empty_tables(spark):
    p = spark.createDataFrame([], PACKETS)
    for f in (traffic.detect_beacons, traffic.detect_bursts, traffic.detect_ttl_anomalies, dns.detect_dns_tunnel):
        assert f(p).count() == 0


def test_uniform_sessions_round_and_cut_as_sql(spark):
    from netloom.operators import tls

    rows = [("a", "b", t, "j") for t in [8.5] * 7 + [9.0] * 13] + [("c", "d", t, "j") for t in [4.0] * 4 + [16.0] * 4 + [10.0]] + [("e", "f", 8.75, "j")] * 9
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, session_duration double, ja3 string").withColumn("protocol", F.lit("TLS"))
    got = {r.src_ip: r.mean_duration for r in tls.detect_uniform_sessions(df, 5, 0.6).collect()}
    # a mean of 8.825 is 8.82 in SQL, and a ratio of 6 / 10 is not below 0.6
    assert got == {"a": duckdb.connect().execute("SELECT round(8.825::DOUBLE, 2)").fetchall()[0][0], "e": 8.75}


def test_exfil_thresholds(spark):
    f = lambda s, d, b: (s, d, b)
    df = spark.createDataFrame([f("a", "b", 1000), f("b", "a", 100), f("c", "d", 999), f("d", "c", 100), f("e", "g", 5000)], "src_ip string, dst_ip string, total_bytes long")
    assert [(r.src_ip, r.ratio) for r in traffic.detect_exfil(df, 1000, 10).collect()] == [("a", 10.0)]


def test_sequential_access_uses_last_accepted_row(spark):
    rows = [("10.0.0.1", f"10.0.1.{i}", 445, 100.0 + 29.0 * i, f"f{i}") for i in range(6)] + [("10.0.0.2", "10.0.1.1", 445, 100.0 + 29.0 * i, f"g{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, start_time double, flow_id string")
    assert [(r.src_ip, r.targets, r.score) for r in lateral.detect_sequential(df).collect()] == [("10.0.0.1", 6, 90)]


def test_range_join_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    a = [(rng.randrange(3), rng.random() * 100) for _ in range(60)]
    b = [(rng.randrange(3), rng.random() * 100) for _ in range(60)]
    got = bucketed_range_join(spark.createDataFrame(a, "k int, t double"), spark.createDataFrame(b, "j int, u double"), [("k", "j")], "t", "u", 0.5, 10.0).collect()
    want = [(k, t, j, u) for k, t in a for j, u in b if k == j and 0.5 < u - t < 10]
    assert sorted((r.k, r.t, r.j, r.u) for r in got) == sorted(want)


def test_ip_ranges_and_suffixes(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("200.0.0.1",), ("x",), (None,)], "ip string").withColumn("n", S.ip_to_long("ip"))
    blocks = spark.createDataFrame([(0, 2**31, 2, "wide"), (10 << 24, (11 << 24) - 1, 1, "ten")], "start_ip long, end_ip long, block_order int, region string")
    assert {r.ip: r.region for r in ip_range_join(ips, "n", blocks).collect()} == {"10.1.2.3": "ten", "200.0.0.1": None, "x": None, None: None}
    names = spark.createDataFrame([("a.B.evil.com",), ("evil.com",), ("notevil.com",), (None,)], "d string")
    bad = spark.createDataFrame([("evil.com",), ("b.evil.com",)], "value string")
    assert {r.d: r.matched for r in suffix_join(names, "d", bad).collect()} == {"a.B.evil.com": "b.evil.com", "evil.com": "evil.com", "notevil.com": None, None: None}


def test_scalar_functions(spark):
    r = spark.createDataFrame([("aabb.example.com", "172.32.0.1", "")], "d string, ip string, e string").select(S.label_entropy("d").alias("h"), S.entropy_of("e").alias("z"), S.is_internal("ip").alias("i"), S.is_internal("ip", False).alias("l"), S.severity_rank(S.F.lit("high")).alias("s")).first()
    assert (r.h, r.z, r.i, r.l, r.s) == (1.0, 0.0, False, True, 3)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_runs_and_counts_agree(spark):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql, queries = catalog.oracle_sql(), catalog.queries()
    assert set(sql) <= set(queries)
    for name in ("beacons", "flow_labels", "pivots", "dns_tunnels"):
        got = queries[name](spark, SF)
        want = c.execute(sql[name])
        assert sorted(got.columns) == sorted(d[0] for d in want.description) and got.count() == len(want.fetchall()), name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
