"""Feeds, ingest and stored results on literal documents."""

import json

from netloom.sources import events, feeds


def _docs(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def test_feeds(spark):
    a = feeds.abuse_reports(_docs(spark, {"data": {"ipAddress": "1.1.1.1", "abuseConfidenceScore": 80, "isTor": True, "reports": [{"categories": [14, 99]}, {"categories": [14]}]}}, "no json", {"data": {}}), {14: "port_scan"})
    r = a.collect()
    assert len(r) == 1 and (r[0].score, r[0].malicious, r[0].categories, r[0].tags) == (80.0, True, ["category_99", "port_scan"], ["tor"])
    v = feeds.engines(_docs(spark, {"data": {"id": "1.1.1.1", "attributes": {"last_analysis_stats": {"malicious": 6, "harmless": 4}, "tags": ["Tor"]}}}, {"data": {"id": "2.2.2.2", "attributes": {}}}))
    assert {x.ip: (x.score, x.malicious, x.categories) for x in v.collect()} == {"1.1.1.1": (60.0, True, ["malicious", "high_risk", "tor"]), "2.2.2.2": (0.0, False, [])}
    p = feeds.pulses(_docs(spark, {"indicator": "2.2.2.2", "pulse_info": {"count": 9, "pulses": [{"id": "p", "tags": ["b", "a"]}, {"id": "q", "attack_ids": [{"id": "T1", "display_name": "One"}]}]}}))
    assert [(x.score, x.malicious, x.categories, x.tags) for x in p.collect()] == [(100.0, True, ["One"], ["a", "b"])]
    nodes = spark.createDataFrame([("2.2.2.2", "exit")], "ip string, node_type string")
    got = {x.ip: x for x in feeds.fuse_reputation(a.unionByName(v).unionByName(p), nodes).collect()}
    assert got["1.1.1.1"].score == round((80 * 0.4 + 60 * 0.35) / 0.75, 1) and not got["1.1.1.1"].is_relay
    assert got["2.2.2.2"].score == round(70 / 0.6, 1) and "tor_node" in got["2.2.2.2"].categories


def test_pulses_and_relays(spark):
    x = feeds.explode_pulses(_docs(spark, {"id": "p", "name": "n", "attack_ids": [{"id": "T1"}], "indicators": [{"type": "IPv4", "indicator": "1.1.1.1"}, {"type": "domain", "indicator": "x.y"}]}))
    assert {(r.value, tuple(r.techniques), r.tlp) for r in x.collect()} == {("1.1.1.1", ("T1",), "white"), ("x.y", ("T1",), "white")}
    d = feeds.relay_details(_docs(spark, {"relays": [{"fingerprint": "A", "or_addresses": ["1.1.1.1:9001", "[::1]:9001"], "flags": ["Guard", "Exit"]}, {"fingerprint": "B", "or_addresses": ["1.1.1.1:1"], "flags": ["Guard"]}, {"fingerprint": "C", "or_addresses": ["3.3.3.3:1"]}]}))
    assert {r.ip: r.node_type for r in d.collect()} == {"1.1.1.1": "exit", "::1": "exit", "3.3.3.3": "relay"}


def test_ingest(spark):
    good, bad = events.ingest(_docs(spark, {"alert_id": "a", "severity": "HIGH", "extra": 1}, {"alert_id": "b"}, "junk", {"alert_id": "c", "severity": "LOW", "threat_score": "high"}), "alert", "t", "s")
    assert [(r.alert_id, r.tenant_id, r.sensor_id) for r in good.collect()] == [("a", "t", "s")] and bad.count() == 3 and "extra" not in good.columns


def test_results_and_idempotent_alerts(spark, tmp_path):
    path, df = str(tmp_path / "r"), spark.createDataFrame([(1,), (2,)], "x int")
    events.save_result(df, path, "s1", "beacons", 1.0)
    events.save_result(df.limit(1), path, "s1", "beacons", 2.0)
    events.save_result(df, path, "s2", "beacons", 3.0)
    assert [r.created for r in events.latest_result(spark, path, "s1", "beacons").collect()] == [2.0]
    alerts = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "alert_id string, n int")
    for _ in range(2):
        events.insert_new_alerts(alerts, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_counts(spark):
    from netloom.operators import tls, views

    i = spark.createDataFrame([("ip", "a"), ("ip", "b"), ("domain", None)], "ioc_type string, source string")
    assert {(r.ioc_type, r.indicators, r.sources) for r in views.indicator_counts(i).collect()} == {("ip", 2, 2), ("domain", 1, 0)}
    n = spark.createDataFrame([("1", "exit"), ("1", "exit"), ("2", "guard")], "ip string, node_type string")
    assert {(r.node_type, r.nodes) for r in views.node_counts(n).collect()} == {("exit", 1), ("guard", 1)}
    f = spark.createDataFrame([("f", "a", "b", "eb1d94daa7e0344597e756a1fb6e117a", None), ("g", "a", "b", None, "x")], "flow_id string, src_ip string, dst_ip string, ja3 string, ja3s string")
    assert [(r.flow_id, r.tool) for r in tls.detect_mitm(f).collect()] == [("f", "Burp Suite")]
