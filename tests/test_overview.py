"""Odd rows of the reads that put tables together, and the stream of live counters."""

from pyspark.sql import functions as F

from netloom.operators import overview


def test_live_counters_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", p, n, j) for s in range(0, 59, 3) for p, n, j in (("TLS", "a.b", "bad"), ("DNS", "", None), (None, None, "ok"))]
    df = spark.createDataFrame(rows, "ts string, protocol string, sni string, ja3 string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    malware = spark.createDataFrame([("bad", "x"), ("bad", "y")], "ja3 string, malware string")
    out = overview.live_counters(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), malware)
    q = out.writeStream.format("memory").queryName("live_counters").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got, want = sorted(map(str, spark.table("live_counters").collect())), sorted(map(str, overview.live_counters(df, malware).collect()))
    assert got == want and any("malware=4" in r for r in got)


def test_bytes_and_counts(spark):
    df = spark.createDataFrame([(b"",), (b"aaaa",), (bytes(range(256)) + b"zzz",), (None,), (b"ab" * 500,)], "b binary")
    assert [r.e for r in df.select(overview.byte_entropy(F.col("b")).alias("e")).collect()] == [0.0, 0.0, 8.0, 0.0, 1.0]
    got = spark.createDataFrame([(["b", "a", "b"],), ([],)], "x array<string>").select(overview.count_map(F.col("x")).alias("m")).collect()
    assert [r.m for r in got] == [{"a": 1, "b": 2}, {}]


def test_bytes_behind_the_first_256_count(spark):
    df = spark.createDataFrame([(b"a" * 256 + b"b" * 256,), (bytes(range(256)) * 40,), (b"",), (None,)], "b binary")
    assert [r.e for r in df.select(overview.byte_entropy(F.col("b"), None).alias("e")).collect()] == [1.0, 8.0, 0.0, 0.0]


def test_empty_tables(spark):
    edges = spark.createDataFrame([("a", "b", 1, 1)], "src string, dst string, weight long, flows long")
    assert overview.graph_summary(edges).isEmpty()
    audit = spark.createDataFrame([("x", "t2", "u", "read", "r", 1.0)], "audit_id string, tenant_id string, user_id string, action string, resource string, at double")
    assert overview.audit_query(audit, "t1").isEmpty() and overview.audit_query(audit, "t2", "u", "read", "r", 0.5).count() == 1
    alerts = spark.createDataFrame([], "status string, severity string, assignee string, tenant_id string, resolved double, created double")
    assert overview.posture(alerts).first().alerts == 0


def test_features_by_name(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, x int, y double")
    assert [tuple(r) for r in overview.feature_rows(df, "k").collect()] == [("a", "x", 1.0), ("a", "y", None)]
    assert overview.feature_map(df, "k").first().features == {"x": 1.0, "y": None}


def test_an_entropy_compares_no_character_with_every_other_one(spark):
    df = spark.createDataFrame([(b"\x00\xff\x00a",), (b"",), (None,)], "b binary").select(overview.byte_entropy(F.col("b")).alias("e"))
    assert [r.e for r in df.collect()] == [1.5, 0.0, 0.0]
    assert "filter(" not in df._jdf.queryExecution().optimizedPlan().toString()
