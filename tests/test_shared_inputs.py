"""Inputs that several parts of a query read are derived once; tasks stay small."""

from pyspark.sql import functions as F

from netloom.operators import features, relay
from netloom.plans import catalog_overview, catalog_threats
from netloom.sources import storage
from tests.conftest import SF


def test_endpoint_features_derive_their_inputs_once(spark):
    x = catalog_threats.queries()["endpoint_features"](spark, SF)
    assert not any("lineitem" in f or "events" in f for f in x.inputFiles())
    rows = [("a", d, p) for d, p in (("x", 443), ("x", 22), ("y", 443), ("y", None), (None, 80))]
    flows = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int").withColumns({"protocol": F.lit("TLS"), "session_duration": F.lit(1.0), "packet_count": F.lit(1), "total_bytes": F.lit(1), "tls_version": F.lit("x"), "ja3": F.lit("j")})
    packets = spark.createDataFrame([(1, 1.0, "a", 5)], "packet_id long, timestamp double, src_ip string, size int")
    r = features.endpoint_features(flows, packets).first()
    assert (r.port, r.destination_ratio, r.flows) == (round(261.5 / 65535, 4), 0.4, 5)


def test_the_timeline_derives_its_inputs_once(spark):
    x = catalog_overview.queries()["anomaly_timeline"](spark, SF)
    assert not any("lineitem" in f or "events" in f for f in x.inputFiles()) and x.where("kind = 'relay'").count() > 0


def test_relay_clients_sort_only_the_earliest_flows(spark):
    rows = [("f2", "a", "d", 443, 2.0), ("f1", "a", "d", 443, 2.0), ("f0", "a", "d", 443, 3.0), ("f9", None, "d", 1, None), ("f8", None, "d", 1, 1.0)]
    flows = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string, dst_port int, start_time double").withColumns({"protocol": F.lit("TLS"), "sni": F.lit("s"), "ja3": F.lit("j")})
    x = relay.relay_client_fingerprints(flows, clients=spark.createDataFrame([("j", "c")], "ja3 string, client string"))
    assert sorted((r.kind, r.flow_id) for r in x.collect()) == [("ja3_match", "f1"), ("ja3_match", "f9")]
    assert "_of_t" in x._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_sorts_few_rows_of_a_session(spark, tmp_path):
    df = spark.range(400).select(F.lit("s").alias("session_id"), F.col("id").cast("double").alias("start_time"))
    storage.write_by_session(df, str(tmp_path), "start_time", per_task=50)
    x = spark.read.parquet(str(tmp_path)).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in x) == 400 and max(r["count"] for r in x) < 100
