"""Streaming against batch, models' properties, closed-form graphs, feeds."""

import json

import pytest

from netloom.operators import graph, intel, models, soc
from netloom.streaming import detectors


def test_stream_equals_batch(spark, tmp_path):
    flow = lambda i, dst, t, size=10: {"tenant_id": "t", "flow_id": str(i), "src_ip": "a", "dst_ip": dst, "dst_port": 1, "protocol": "TCP", "start_time": t, "session_duration": 1.0, "total_bytes": size, "packet_count": 1}
    lines = [json.dumps(flow(i, f"d{i % 12}", 1000.0 + i)) for i in range(40)] + ["not json", json.dumps(flow(99, "z", 9_000.0, 60_000_000))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    raw = spark.readStream.text(str(tmp_path / "in"))
    for name, f in (("wide", lambda x: detectors.wide_sources(x, 5)), ("fan", lambda x: detectors.fan_out(x, 5)), ("exfil", detectors.fast_exfil)):
        q = f(detectors.decode_flows(raw)).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        got = [r.asDict() for r in spark.table(name).collect()]
        if name == "exfil":
            assert [r["flow_id"] for r in got] == ["99"]
        else:
            batch = [r.asDict() for r in f(detectors.decode_flows(spark.read.text(str(tmp_path / "in")))).collect()]
            assert got and sorted(map(str, got)) == sorted(map(str, batch))


def test_isolation_forest_ranks_a_planted_outlier_first(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(400)] + [(999, 500.0, -300.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    s = models.IsolationForest(40).fit(df, ["x", "y"], "id").score(df).collect()
    assert all(0 <= r.anomaly_score <= 1 for r in s) and max(s, key=lambda r: r.anomaly_score).id == 999


def test_min_max_and_metrics(spark):
    df = spark.createDataFrame([(1, 5.0, True, True), (3, 5.0, False, True), (2, 5.0, True, False)], "a int, c double, y boolean, p boolean")
    out, state = models.min_max(df, ["a", "c"])
    assert sorted((r.a, r.c) for r in out.collect()) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    later, _ = models.min_max(spark.createDataFrame([(9, 9.0)], "a int, c double"), ["a", "c"], state)
    assert later.first().a == 1.0
    m = models.binary_metrics(df, "y", "p").first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.3333, 0.5, 0.5, 0.5)


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 100, 1) for a, b in pairs], "src string, dst string, weight long, flows long")


def test_closed_form_graphs(spark):
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    assert [r.rank for r in graph.page_rank(ring, rounds=10).collect()] == pytest.approx([1 / 3] * 3)
    star = edges(spark, *[(f"l{i}", "hub") for i in range(9)])
    r = {x.node: x.rank for x in graph.page_rank(star).collect()}
    assert r["hub"] == pytest.approx(0.015 + 0.85 * 9 * 0.015) and r["l0"] == pytest.approx(0.015)
    full = edges(spark, *[(a, b) for a in "abc" for b in "abc" if a != b])
    assert {x.clustering for x in graph.clustering(full).collect()} == {1.0}
    two = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"))
    labels = {x.node: x.label for x in graph.label_propagation(two).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["x"] == labels["y"] == labels["z"]


def test_intel(spark):
    feed = spark.createDataFrame([("domain", "Evil.com", "f", 1, "HIGH", 5, 9), ("domain", "evil.com", "g", 2, "LOW", 1, 3), ("ip", "1.2.3.4", "f", 1, "LOW", 1, 1)], "ioc_type string, value string, source string, confidence int, severity string, first_seen int, last_seen int")
    ind = intel.load_indicators(feed)
    assert {(r.value, r.first_seen, r.last_seen, r.source) for r in ind.collect()} == {("evil.com", 1, 9, "f"), ("1.2.3.4", 1, 1, "f")}
    flows = spark.createDataFrame([("f1", "1.2.3.4", "2.2.2.2", None, None), ("f2", "3.3.3.3", "4.4.4.4", "a.evil.com", None), ("f3", "3.3.3.3", "4.4.4.4", "ok.com", "j")], "flow_id string, src_ip string, dst_ip string, sni string, ja3 string")
    assert {r.flow_id for r in intel.enrich_flows(flows, ind).collect()} == {"f1", "f2"}
    lines = spark.createDataFrame([("ExitNode 9.9.9.9",), ("# no",), ("8.8.8.8 # x",), ("junk",)], "value string")
    assert {r.ip for r in intel.read_relay_list(lines).collect()} == {"9.9.9.9", "8.8.8.8"}
    threats = spark.createDataFrame([(1, ["from 1.1.1.1 to 2.2.2.2", None]), (2, None)], "id int, evidence array<string>")
    assert intel.addresses_in_text(threats, "id").count() == 2


def test_export_lines(spark):
    a = spark.createDataFrame([("a1", "x|y", "HIGH", None, "1.1.1.1", "2.2.2.2", 5, "open", 0.0, "s")], "alert_id string, title string, severity string, category string, src_ip string, dst_ip string, threat_score int, status string, created double, session_id string")
    line = lambda f: soc.export(a, f).first().line
    assert line("cef").startswith("CEF:0|Netloom|Analytics|1.0|network|x\\|y|8|src=1.1.1.1 ")
    assert line("leef").startswith("LEEF:2.0|") and line("syslog").startswith("<83>1 1970-01-01T00:00:00.000Z ")
    assert json.loads(line("json"))["event"]["alert_id"] == "a1"
