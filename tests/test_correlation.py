"""Circuits, correlation, features and graphs against brute force and literal rows."""

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from netloom.operators import circuits, correlation, features, fingerprints, graph, lateral, relay
from netloom.plans import catalog_threats, fixtures
from tests.conftest import SF

FLOW = "flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, start_time double, session_duration double, packet_count int, total_bytes bigint, sni string, ja3 string"


def _flow(i, src="10.0.0.1", dst="8.8.4.4", t=0.0, port=9001, proto="TLS", size=100, ja3=None, sni=None):
    return (f"f{i}", src, dst, port, proto, t, 1.0, 2, size, sni, ja3)


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1, 1) for a, b in pairs], "src string, dst string, weight bigint, flows bigint")


def test_relay_chains(spark):
    rows = [_flow(i, dst=f"1.1.1.{i}", t=float(i)) for i in range(5)] + [_flow(9, dst="1.1.1.9", t=500.0), _flow(10, src="9.9.9.9", dst="1.1.1.1", t=1.0)]
    got = {r.start_time: r for r in circuits.relay_chains(spark.createDataFrame(rows, FLOW)).collect()}
    assert {t: r.n_hops for t, r in got.items()} == {0.0: 5, 1.0: 4, 2.0: 3}
    assert got[0.0].hops == "1.1.1.0,1.1.1.1,1.1.1.2,1.1.1.3,1.1.1.4" and got[0.0].build_ms == 4000.0 and got[0.0].bytes == 500
    same = spark.createDataFrame([_flow(i, dst="1.1.1.1", t=float(i)) for i in range(5)], FLOW)
    assert circuits.relay_chains(same).count() == 0  # one destination makes no chain
    assert circuits.circuit_stats(circuits.relay_chains(same)).first().circuits == 0


def test_bridges_and_onions(spark):
    flows = spark.createDataFrame([_flow(1, port=9999, sni="x"), _flow(2, port=20000, proto="UDP"), (*_flow(3)[:7], 60, 5, "www.google.com", None)], FLOW)
    packets = spark.createDataFrame([("f1", 64 + 7 * i) for i in range(50)] + [("f2", 200) for _ in range(50)], "flow_id string, size int")
    assert {(r.flow_id, r.kind) for r in circuits.detect_bridges(flows, packets).collect()} == {("f1", "obfs4"), ("f2", "snowflake"), ("f3", "meek")}
    names = spark.createDataFrame([(1, "a", "b", "x.ONION"), (2, "a", "b", "x.onion.to"), (3, "a", "b", "onion.com"), (4, "a", "b", None)], "packet_id int, src_ip string, dst_ip string, dns_query string")
    assert [r.packet_id for r in circuits.onion_leaks(names).orderBy("packet_id").collect()] == [1, 2]


def test_volume_pairs_equals_brute_force(spark):
    rng = random.Random(4)
    side = lambda n, p: [(f"{p}{i}", f"{p}s{i % 9}", f"{p}d{i % 4}", 1, "TLS", rng.uniform(0, 9e6), rng.uniform(0, 4e6), 1, rng.randrange(5_000, 90_000), None, None) for i in range(n)]
    a, b = side(40, "a"), side(40, "b")
    got = {(r.in_src, r.in_dst, r.out_src, r.out_dst) for r in circuits.volume_pairs(spark.createDataFrame(a, FLOW), spark.createDataFrame(b, FLOW)).collect()}

    def spans(rows):
        out = defaultdict(list)
        for r in rows:
            if r[8] > 10_000:
                out[r[1], r[2]].append((r[5], r[5] + r[6], r[8]))
        return {k: (min(x[0] for x in v), max(x[1] for x in v), sum(x[2] for x in v)) for k, v in out.items()}

    want = set()
    for k, (s, e, n) in spans(a).items():
        for m, (t, f, o) in spans(b).items():
            overlap, ratio = (min(e, f) - max(s, t)) / (max(e, f) - min(s, t)), o / (n * 0.95)
            if overlap >= 0.3 and 0.5 < ratio < 2 and max(0, 1 - abs(1 - ratio)) * overlap > 0.3:
                want.add((*k, *m))
    assert want and got == want


def test_fingerprints(spark):
    rows = [("f1", "d1", "own", None, None, "n"), ("f2", "d1", None, 4865, 771, None), ("f3", "d2", "", 4865, 771, "m"), ("f4", "d3", None, None, 771, None)]
    df = spark.createDataFrame(rows, "flow_id string, dst_ip string, ja3s string, server_cipher int, tls_version_id int, sni string")
    got = {r.ja3s: (r.flows, r.servers) for r in fingerprints.ja3s_fingerprints(df).collect()}
    assert got.pop("own") == (1, 1) and list(got.values()) == [(2, 2)]
    h2 = spark.createDataFrame([("a", {1: 2, 3: 4}), ("b", {3: 4, 1: 2}), ("c", {}), ("d", None)], "src_ip string, h2_settings map<int,int>")
    assert [(r.flows, r.sources) for r in fingerprints.h2_fingerprints(h2).collect()] == [(2, 2)]
    merged = fingerprints.registry_merge(spark.createDataFrame([("a", 3)], "hash string, hits bigint"), spark.createDataFrame([("a",), ("b",), (None,)], "ja3 string"))
    assert {(r.hash, r.hits) for r in merged.collect()} == {("a", 4), ("b", 1)}


def test_timed_groups_equals_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), float(rng.randrange(3000)), f"i{i}") for i in range(200)]
    got = {r.alert_id: r.group_no for r in correlation.timed_groups(spark.createDataFrame(rows, "k string, created double, alert_id string"), "k").collect()}
    for k in "abc":
        start, no = None, -1
        for _, t, i in sorted(r for r in rows if r[0] == k):
            if start is None or t - start > 300:
                start, no = t, no + 1
            assert got[i] == no
    assert correlation.timed_groups(spark.createDataFrame([], "k string, created double, alert_id string"), "k").count() == 0


def test_triage_order_and_nulls(spark):
    rows = [("a", "CRITICAL", "new", "tor_exit", 90.0, None), ("b", "INFO", "new", None, None, "u"), ("c", None, "new", "dga", 10.0, "u")]
    out = {r.alert_id: r for r in correlation.triage(spark.createDataFrame(rows, "alert_id string, severity string, status string, category string, threat_score double, assignee string")).collect()}
    assert (out["a"].status, out["a"].assignee, out["a"].tags) == ("triaged", "senior_analyst", ["tor_related"])
    assert out["a"].actions == ["escalate=soc_manager", "tag=tor_related", "auto_assign=senior_analyst"]
    assert (out["b"].status, out["c"].status, out["c"].actions) == ("resolved", "new", [])


def test_state_changes(spark):
    rows = [("a", "new", 1), ("a", "resolved", 2), ("a", "triaged", 3), ("b", "triaged", 1)]
    df = spark.createDataFrame(rows, "alert_id string, status string, at int")
    assert {(r.alert_id, r.at): r.valid for r in correlation.check_transitions(df).collect()} == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): False}
    assert {r.alert_id: r.status for r in correlation.latest_states(df).collect()} == {"a": "triaged", "b": "triaged"}


def test_hypotheses_need_every_required_signal(spark):
    rows = [("x", "beacon"), ("x", "malware_ja3"), ("x", "dga_domain"), ("y", "beacon"), ("y", "dga_domain")]
    got = correlation.hypotheses(spark.createDataFrame(rows, "ip string, signal string")).collect()
    assert [(r.ip, r.hypothesis, r.confidence, r.verdict) for r in got] == [("x", "c2_active", 0.6, "possible")]


def test_betweenness_equals_brandes(spark):
    rng = random.Random(7)
    names = [f"n{i:02}" for i in range(14)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(40)}
    pairs = {(a, b) for a, b in pairs if a != b}
    nodes, near = {x for p in pairs for x in p}, defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
    total = defaultdict(float)
    for s in sorted(nodes):
        dist, paths, order, before, q = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list), deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    n = len(nodes)
    got = {r.node: r.betweenness for r in graph.betweenness(_edges(spark, pairs), sources=n).collect()}
    assert got.keys() == nodes and all(abs(got[v] - total[v] * 2 / ((n - 1) * (n - 2))) < 1e-5 for v in nodes)


def test_betweenness_takes_every_source(spark):
    # a chain of 120 nodes, and 60 nodes that reach 600 others by one
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(119)] + [(f"a{i:02}", "hub") for i in range(60)] + [("hub", f"z{i:03}") for i in range(600)]
    got = {r.node: r.betweenness for r in graph.betweenness(_edges(spark, pairs)).collect()}
    n = 120 + 661
    want = {f"c{i:03}": i * (119 - i) for i in range(120)} | {"hub": 60 * 600}
    assert len(got) == n and all(abs(v - want.get(k, 0) * 2 / ((n - 1) * (n - 2))) < 1e-6 for k, v in got.items())
    assert graph.betweenness(_edges(spark, pairs[:0])).count() == 0


def test_components(spark):
    pairs = [(f"a{i:03}", f"a{i + 1:03}") for i in range(60)] + [("z2", "z1"), ("z3", "z2")]
    got = {r.node: r.component for r in graph.connected_components(_edges(spark, pairs)).collect()}
    assert set(got.values()) == {"a000", "z1"} and sum(c == "z1" for c in got.values()) == 3 and len(got) == 64


def test_sequences(spark):
    rows = [(i, "f", "a" if i % 2 == 0 else "b", float(i * i), 100) for i in range(6)] + [(9, "g", "a", 1.0, 5)]
    got = features.timing_sequences(spark.createDataFrame(rows, "packet_id int, flow_id string, src_ip string, timestamp double, size int"), length=8).collect()
    assert [r.flow_id for r in got] == ["f"] and len(got[0].sequence) == 8
    assert [s[0] for s in got[0].sequence] == [0, 0, 0, 1, 3, 5, 7, 9] and [s[2] for s in got[0].sequence][3:] == [-1, 1, -1, 1, -1]


def test_roles(spark):
    e = _edges(spark, [("10.0.0.1", f"10.0.1.{i}") for i in range(30)] + [(f"10.0.2.{i}", "5.5.5.5") for i in range(8)])
    got = {r.node: r.role for r in graph.node_roles(e, graph.betweenness(e)).collect()}
    assert (got["10.0.0.1"], got["5.5.5.5"], got["10.0.1.3"]) == ("scanner", "c2_server", "workstation")


def test_domain_model(spark):
    df = spark.createDataFrame([("xkqzvbnwrtplkjhgfdsq7391.biz",), ("the.org",), ("ab.com",), (None,), ("the.org",)], "domain string")
    got = {r.domain: r for r in features.domain_model(df).collect()}
    assert len(got) == 3 and got["xkqzvbnwrtplkjhgfdsq7391.biz"].is_dga and not got["the.org"].is_dga and got["ab.com"].score == 0


def test_related_alerts_equal_all_pairs(spark):
    """A hot session and source, null values, several techniques; against every pair."""
    rng = random.Random(5)
    pick = lambda xs, hot: None if rng.random() < 0.05 else xs[0] if rng.random() < hot else rng.choice(xs)
    rows = [
        (f"a{i:03d}", pick(["s1", "s2", "s3"], 0.4), pick(["10.0.0.1", "10.0.0.2", "10.0.0.3"], 0.4), pick(["10.0.0.1", "10.0.0.3", "8.8.8.8", "9.9.9.9"], 0.2), pick(["dga", "beacon", "scan"], 0.2), None if rng.random() < 0.1 else rng.sample(["T1", "T2", "T3", "T4", None], rng.randrange(3)))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "alert_id string, session_id string, src_ip string, dst_ip string, category string, techniques array<string>")
    alike = lambda x, y: x is not None and x == y
    some = lambda xs: {x for x in xs or () if x is not None}
    want = []
    for a in rows:
        got = []
        for b in rows:
            s = 3 * alike(a[1], b[1]) + 2 * alike(a[2], b[2]) + len(some(a[2:4]) & some(b[2:4])) + 2 * alike(a[4], b[4]) + 2 * bool(some(a[5]) & some(b[5]))
            if a[0] != b[0] and s >= 3:
                got.append((-s, b[0]))
        want += [(a[0], b, round(-s / 10, 2), k) for k, (s, b) in enumerate(sorted(got)[:10], 1)]
    assert sorted(map(tuple, correlation.related_alerts(df).collect())) == sorted(want)
    asked = {r[0] for r in rows[:7]}
    assert sorted(map(tuple, correlation.related_alerts(df, df.where(F.col("alert_id").isin(*asked))).collect())) == sorted(w for w in want if w[0] in asked)
    plain = correlation.related_alerts(df.drop("techniques"))
    assert plain.count() > 0 and correlation.related_alerts(df.limit(0)).count() == 0


def test_related_alerts_of_a_hot_source_need_few_sets(spark, monkeypatch):
    """Alerts with enough others of a high score are not listed under sets of a low sum."""
    rows = [(f"a{i:03d}", "s", "10.0.0.1", "8.8.8.8", "dga", ["T1"]) for i in range(40)] + [("z1", "s", "1.1.1.1", "2.2.2.2", "scan", ["T2"])]
    df = spark.createDataFrame(rows, "alert_id string, session_id string, src_ip string, dst_ip string, category string, techniques array<string>")
    asked, inner = [], correlation._related
    monkeypatch.setattr(correlation, "_related", lambda alerts, to, least, n, only: asked.append((least, to.count())) or inner(alerts, to, least, n, only))
    got = correlation.related_alerts(df).collect()
    assert asked == [(10, 41), (8, 1), (6, 1), (3, 1)] and len(got) == 410
    assert [(r.related_id, r.score) for r in sorted(got, key=lambda r: r.place) if r.alert_id == "z1"] == [(f"a{i:03d}", 0.3) for i in range(10)]


def test_sequential_access_equals_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(f"10.0.0.{rng.randrange(4)}", f"10.0.1.{rng.randrange(12)}", rng.choice([22, 445]), float(rng.randrange(4000)), f"f{i:04d}") for i in range(900)]
    want = []
    for s in {r[0] for r in rows}:
        mine, chain = sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[4])), []
        for r in [*mine, None]:
            last = max((k[3] for k in chain), default=0)
            if r is None or not chain or r[3] - last > 30:
                if len(chain) >= 5:
                    want.append((s, min(k[1] for k in chain), chain[0][2], len(chain), round(last - chain[0][3], 3), min(100, 60 + 5 * len(chain))))
                chain = [r]
            elif r[1] not in {k[1] for k in chain}:
                chain.append(r)
    df = spark.createDataFrame([*rows, (None, "10.0.1.1", 22, 1.0, "x"), ("10.0.0.1", "10.0.1.1", 22, None, "y")], "src_ip string, dst_ip string, dst_port int, start_time double, flow_id string")
    got = lateral.detect_sequential(df)
    assert len(want) > 5 and sorted(map(tuple, got.collect())) == sorted(want)
    assert lateral.detect_sequential(df.limit(0)).count() == 0


def test_relays_are_looked_up_a_row(spark):
    rows = [("f", "10.0.0.1", "86.59.21.38"), ("f", "10.0.0.1", "1.1.1.1"), ("g", "86.59.21.38", "10.0.0.1"), ("h", None, None)]
    got = relay.match_relay_nodes(spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string"))
    assert sorted((r.flow_id, r.dst_ip, r.relay_ip) for r in got.collect()) == [("f", "86.59.21.38", "86.59.21.38"), ("g", "10.0.0.1", "86.59.21.38")]


def test_detectors_derive_their_inputs_once(spark, monkeypatch):
    made = []
    for name in ("flows", "packets"):
        monkeypatch.setattr(fixtures, name, lambda s, d, name=name, inner=getattr(fixtures, name): made.append(name) or inner(s, d))
    assert not catalog_threats._detected(spark, SF).isEmpty() and sorted(made) == ["flows", "packets"]


def test_similar_flows_round_like_the_sql_and_sort_narrow_rows(spark):
    rows = [(f"f{i:02}", "a", 443, 60.0 * i, 1.0 + i % 3, 1 + i % 5, 1000 * i) for i in range(60)]
    flows = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_port int, start_time double, session_duration double, packet_count int, total_bytes long")
    x = correlation.similar_flows(flows, threshold=0.0)
    v = [(r[5], r[6] / 1e6, r[4], 443 / 65535) for r in rows]
    unit = lambda p: sum(q * q for q in p) ** 0.5
    want = {(rows[i][0], rows[j][0]): int(sum(p * q for p, q in zip(v[i], v[j], strict=True)) / (unit(v[i]) * unit(v[j])) * 10000 + 0.5) / 10000 for i in range(60) for j in range(i + 1, min(i + 50, 60))}
    assert {(r.flow_a, r.flow_b): r.similarity for r in x.collect()} == want
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan and "src_ip" not in plan.split("LogicalRDD")[0].split("LocalRelation")[0]
