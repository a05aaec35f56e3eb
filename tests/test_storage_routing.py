"""Stored sessions, STIX pages, alert routing, infrastructure and SQL functions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.functions import sql
from netloom.operators import hunting, infrastructure, stix_store
from netloom.sources import storage
from netloom.streaming import routing


def test_a_session_read_opens_few_files(spark, tmp_path):
    day, path = 86_400.0, str(tmp_path / "flows")
    rows = spark.range(4000).selectExpr("cast(id as string) as flow_id", "concat('s', id % 40) as session_id", f"id div 40 % 10 * {day} + id as start_time")
    storage.write_by_session(rows, path, "start_time")
    storage.write_by_session(spark.createDataFrame([("x", None, None)], rows.schema), path, "start_time")
    got = storage.read_session(spark, path, "s7", 3 * day, 8 * day)
    want = rows.where(f"session_id = 's7' and start_time >= {3 * day} and start_time < {8 * day}")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == rows.columns
    every = len(spark.read.parquet(path).inputFiles())
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and re.search(r"PartitionFilters: \[[^\]]*session_bucket", scan) and re.search(r"PartitionFilters: \[[^\]]*event_date", scan)
    read = got.select(F.input_file_name().alias("f")).distinct().count()
    assert every > 200 and read <= 5
    assert storage.read_session(spark, path, "no such").isEmpty()


def test_pages_add_up(spark):
    rng = random.Random(2)
    rows = [("c", f"id{i}", rng.choice("ab"), float(rng.randint(0, 20)), str(i)) for i in range(200)] + [("other", "x", "a", 1.0, "y")]
    objects = spark.createDataFrame(rows, stix_store.OBJECTS).cache()
    seen, after = [], None
    while True:
        page, after = stix_store.stix_page(objects, "c", after, size=rng.randint(20, 90))
        if after is None:
            break
        seen += [r.stix_id for r in page.collect()]
    assert len(seen) == len(set(seen)) == 200
    newest, more = stix_store.stix_query(objects, "c", 5.0, "a", 7)
    want = sorted((r[3], r[1]) for r in rows if r[0] == "c" and r[2] == "a" and r[3] > 5)[-7:]
    assert [(r.added, r.stix_id) for r in newest.collect()] == want and more
    assert not stix_store.stix_query(objects, "none")[1]


def test_pages_add_up_with_equal_times_and_ids(spark):
    rows = [("c", f"id{i % 3}", "a", float(i % 2), f"v{i:02d}") for i in range(40)]
    objects = spark.createDataFrame(rows, stix_store.OBJECTS).cache()
    seen, after = [], (0.0, "")
    while after is not None:
        page, after = stix_store.stix_page(objects, "c", after, size=7)
        seen += [r.line for r in page.collect()]
    assert seen == [r[4] for r in sorted(rows, key=lambda r: (r[3], r[1], r[4]))]


def test_a_batch_stopped_between_sinks_leaves_each_alert_once(spark, tmp_path):
    alert = lambda i: {"alert_id": f"a{i}", "tenant_id": "t", "severity": "HIGH", "category": "dga", "title": "x", "src_ip": "1.2.3.4", "dst_ip": "5.6.7.8", "threat_score": 9.0, "status": "new", "technique": "T1071", "ts": "2024-01-01 00:00:00"}
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(alert(i % 30)) for i in range(40)))
    schema = "alert_id string, tenant_id string, severity string, category string, title string, src_ip string, dst_ip string, threat_score double, status string, technique string, ts timestamp"
    broken = [True]

    def second(batch, number):
        if broken:
            broken.clear()
            raise RuntimeError("stopped between two sinks")
        routing.files(str(tmp_path / "two"))(batch, number)

    sinks = {"one": routing.siem(str(tmp_path / "one")), "stix": routing.stix(str(tmp_path / "stix")), "two": second}
    run = lambda: routing.route(spark.readStream.schema(schema).json(str(source)), sinks, str(tmp_path / "check")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped between"):
        run().awaitTermination()
    run().awaitTermination()
    (source / "b.json").write_text("\n".join(json.dumps(alert(i)) for i in range(30, 35)))
    run().awaitTermination()
    for part in ("one", "two"):
        got = [r.alert_id for r in spark.read.parquet(str(tmp_path / part)).collect()]
        assert sorted(got) == sorted(f"a{i}" for i in range(35))
    assert spark.read.parquet(str(tmp_path / "stix")).select("stix_id").distinct().count() >= 2
    rows = routing.kafka_rows(spark.read.schema(schema).json(str(source))).collect()
    assert {bytes(r.key) for r in rows} == {b"t"} and json.loads(bytes(rows[0].value))["alert_id"] == bytes(rows[0].headers[0].value).decode()


def test_evidence_of_many_addresses_is_a_star(spark):
    many = [f"at 9.{i // 250}.{i % 250}.1" for i in range(3000)]
    rows = [("t1", "tor_c2", 0.5, "s", 1.0, many), ("t2", "dga", 0.9, "s2", 2.0, ["9.0.0.1 and 10.0.0.1 at Evil.Example, x.io", "9.0.0.1", None]), ("t3", "odd", 0.1, None, 3.0, None), ("t4", "odd", 0.1, None, 0.0, ["8.8.8.8"])]
    threats = spark.createDataFrame(rows, "threat_id string, threat_type string, score double, session_id string, created double, evidence array<string>")
    assert infrastructure.infrastructure_links(threats).count() == 2999
    nodes = {r.ip: r for r in infrastructure.infrastructure_nodes(threats).collect()}
    assert len(nodes) == 3001 and nodes["9.0.0.1"].node_type == "proxy" and nodes["9.0.0.1"].confidence == 0.9 and nodes["9.0.0.1"].threat_types == "dga,tor_c2" and nodes["8.8.8.8"].node_type == "unknown"
    got = infrastructure.connections(threats, spark.createDataFrame([("9.0.0.1",), ("8.8.8.8",)], "ip string")).collect()
    assert [(r.ip, r.connections) for r in got] == [("9.0.0.1", 2999)] and len(got[0].some.split(",")) == 20
    names = infrastructure.name_links(threats, spark.createDataFrame([("evil.example",)], "domain string")).collect()
    assert [tuple(r) for r in names] == [("evil.example", 1, 1)]
    assert [(r.campaign, r.nodes) for r in infrastructure.infrastructure_campaigns(threats).collect()] == [("9.0.0.1", 3000)]


def test_sql_functions_equal_columns(spark):
    values = ["www.example.com", "a", "", None, "xkcdqzwrtplmnb.evil.biz", "1.2.3.4", "-1.2.3.4", "1.2.3", "300.1.1.1", "a..b", "ÄÖ.é.x", "1.2.3.x"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert sql.register(spark, "tt_") == [f"tt_{n}" for n in sql.FUNCTIONS]
    for name in sql.FUNCTIONS:
        column = F.regexp_like("x", F.lit("^[0-9.]+$")) if name == "is_ip_name" else getattr(S, name)("x")
        got = spark.sql(f"SELECT tt_{name}(x) AS v FROM {{df}}", df=df)
        assert [r.v for r in got.collect()] == [r.v for r in df.select(column.alias("v")).collect()], name
    assert [S.ip_to_long("x") is not None] and df.where("x = '-1.2.3.4'").select(S.ip_to_long("x").alias("n")).first().n is None


def test_growth_over_many_parts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"d{rng.randint(0, 90)}", float(rng.randint(0, 500)), f"f{i}") for i in range(1500)]
    got = {(r.src_ip, r.position): r.destinations for r in hunting.destination_growth(spark.createDataFrame(rows, "src_ip string, dst_ip string, start_time double, flow_id string"), parts=6).collect()}
    want = {}
    for k in "ab":
        mine = [r[1] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3]))]
        want |= {(k, i): len(set(mine[: i + 1])) for i in range(0, len(mine), max(1, len(mine) // 10))}
    assert got == want
