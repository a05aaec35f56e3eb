"""Queries of circuits, fingerprints, correlation and graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import circuits, correlation, dns, features, fingerprints, graph, hunting, lateral, relay, traffic, views
from netloom.operators import reference as R
from netloom.operators.scans import stored
from netloom.plans import catalog, fixtures
from netloom.plans.catalog import _AGG, _AL, _MALWARE, _PK, _alerts, _internal, _on
from netloom.plans.fixtures import duck

_Q: dict = {}
_SQL: dict = {}


def _add(name: str, run, sql: str | None = None) -> None:
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


_GUARDS = "(" + ", ".join(f"'{k}'" for k, v in R.RELAY_NODES.items() if v in circuits.GUARD_KINDS) + ")"
_GAP_ENTROPY = """ge AS (SELECT {k}, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS gap_entropy FROM (
    SELECT {k}, floor(gap / greatest(mid * 0.1, 0.001)) AS b, count(*)::DOUBLE AS c FROM g JOIN (SELECT {k}, median(gap) AS mid FROM g GROUP BY ALL HAVING count(*) >= 11) USING ({k}) GROUP BY ALL) GROUP BY {k})"""

# -- circuits

_add("relay_chains", _on("flows", circuits.relay_chains))
_add("circuit_stats", _on("flows", lambda f: circuits.circuit_stats(circuits.relay_chains(f))))
_add(
    "relay_traffic_classes",
    _on("flows", circuits.classify_relay_traffic),
    duck("flows") + f""", x AS (SELECT src_ip, dst_ip AS relay_ip, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes, sum(total_bytes) / sum(packet_count) AS b, avg(session_duration) AS d
      FROM flows WHERE {_internal('src_ip')} AND dst_ip IN {_GUARDS} GROUP BY ALL)
    SELECT src_ip, relay_ip, flows, bytes, round(b, 1) AS bytes_per_packet, round(d, 2) AS mean_duration, CASE WHEN b < 200 AND d < 5 THEN 'dns_over_tor' WHEN b > 800 AND bytes > 500000 THEN 'file_download'
      WHEN b > 200 AND b < 600 AND d > 30 THEN 'web_browsing' WHEN b < 150 AND flows > 20 THEN 'c2_beaconing' WHEN bytes > 5000000 AND d > 120 THEN 'streaming' ELSE 'general' END AS kind FROM x""",
)


def _first_hosts(f):
    return f.where(F.regexp_like("dst_ip", F.lit(r"^10[.]0[.]\d[.]\d$"))).select(F.col("dst_ip").alias("ip"), F.lit("guard").alias("node_type")).distinct()


_add(
    "rendezvous",
    _on("flows", lambda f: circuits.rendezvous(f, _first_hosts(f), least=1, min_duration=10.0)),
    duck("flows") + f""", o AS (SELECT src_ip, dst_ip, count(*) AS flows, sum(total_bytes)::BIGINT AS sent, sum(session_duration) AS duration FROM flows
      WHERE {_internal('src_ip')} AND regexp_matches(dst_ip, '^10[.]0[.][0-9][.][0-9]$') GROUP BY ALL),
    b AS (SELECT dst_ip AS src_ip, src_ip AS dst_ip, sum(total_bytes)::BIGINT AS received FROM flows GROUP BY ALL)
    SELECT src_ip, dst_ip AS guard_ip, flows, sent, received, round(least(sent, received) / greatest(sent, received), 4) AS ratio, round(duration, 2) AS duration FROM o JOIN b USING (src_ip, dst_ip)
    WHERE sent >= 10000 AND received >= 10000 AND least(sent, received) / greatest(sent, received) > 0.3 AND duration > 10""",
)


def _bridges(p):
    p = traffic.with_flow_id(p)
    return circuits.detect_bridges(traffic.aggregate_flows(p), p, least=10, min_entropy=2.5)


_add(
    "bridges",
    _on("packets", _bridges),
    _PK + _AGG + """, o AS (SELECT * FROM af WHERE protocol = 'TLS' AND dst_port NOT IN (80, 443, 8443) AND packet_count > 10),
    e AS (SELECT flow_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM (SELECT flow_id, size, count(*)::DOUBLE AS c FROM pf GROUP BY ALL) GROUP BY flow_id)
    SELECT flow_id, src_ip, dst_ip, dst_port, 'obfs4' AS kind, round(e, 4) AS value FROM o JOIN e USING (flow_id) WHERE e > 2.5""",
)
_BEHIND = "(src_ip LIKE '198.51.%' AND NOT " + _internal("dst_ip") + ")"


def _sides(f):
    return circuits.to_guards(f), f.where("src_ip like '198.51.%' and dst_ip not like '10.%'")


_add(
    "timing_summary",
    _on("flows", lambda f: circuits.timing_summary(*_sides(f))),
    duck("flows") + f""", a AS (SELECT start_time AS t FROM flows WHERE {_internal('src_ip')} AND dst_ip IN {_GUARDS}), b AS (SELECT start_time AS u FROM flows WHERE {_BEHIND}),
    x AS (SELECT count(*) AS pairs, round(avg(u - t), 3) AS mean_delay, min(t) AS first_seen FROM a JOIN b ON u - t > 0.2 AND u - t < 3.0)
    SELECT *, least(90, 50 + pairs * 3) AS score FROM x WHERE pairs >= 3""",
)
_SPAN = "sum(total_bytes)::BIGINT AS {n}_bytes, min(start_time) AS {n}_start, max(start_time + session_duration) AS {n}_end FROM flows WHERE total_bytes > 10000 AND "
_add(
    "volume_pairs",
    _on("flows", lambda f: circuits.volume_pairs(*_sides(f))),
    duck("flows") + f""", a AS (SELECT src_ip AS in_src, dst_ip AS in_dst, {_SPAN.format(n='in')} {_internal('src_ip')} AND dst_ip IN {_GUARDS} GROUP BY ALL),
    b AS (SELECT src_ip AS out_src, dst_ip AS out_dst, {_SPAN.format(n='out')} {_BEHIND} GROUP BY ALL),
    x AS (SELECT *, out_bytes / (in_bytes * (1 - 0.05e0)) AS ratio, (least(in_end, out_end) - greatest(in_start, out_start)) / (greatest(in_end, out_end) - least(in_start, out_start)) AS overlap FROM a, b),
    y AS (SELECT *, greatest(0.0, 1 - abs(1 - ratio)) * overlap AS score FROM x WHERE overlap >= 0.3 AND ratio > 0.5 AND ratio < 2.0)
    SELECT in_src, in_dst, out_src, out_dst, in_bytes, out_bytes, round(ratio, 4) AS ratio, round(overlap, 4) AS overlap, round(score, 4) AS score FROM y WHERE score > 0.3""",
)
_add(
    "entropy_profiles",
    _on("packets", lambda p: circuits.entropy_profiles(p, 12)),
    duck("packets") + f""", n AS (SELECT src_ip, dst_ip, count(*) AS packets FROM packets GROUP BY ALL HAVING count(*) >= 12),
    se AS (SELECT src_ip, dst_ip, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS size_entropy FROM (SELECT src_ip, dst_ip, size, count(*)::DOUBLE AS c FROM packets GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT src_ip, dst_ip, gap FROM (SELECT src_ip, dst_ip, timestamp - lag(timestamp) OVER (PARTITION BY src_ip, dst_ip ORDER BY timestamp, packet_id) AS gap FROM packets JOIN n USING (src_ip, dst_ip)) WHERE gap > 0),
    {_GAP_ENTROPY.format(k='src_ip, dst_ip')}
    SELECT src_ip, dst_ip, packets, round(size_entropy, 4) AS size_entropy, round(gap_entropy, 4) AS gap_entropy FROM n JOIN se USING (src_ip, dst_ip) JOIN ge USING (src_ip, dst_ip)
    WHERE size_entropy > 3 AND size_entropy < 6 AND gap_entropy > 0 AND gap_entropy < 4""",
)
_add(
    "behaviour_fingerprints",
    _on("packets", lambda p: circuits.behaviour_fingerprints(p, least=12)),
    duck("packets") + f""", x AS (SELECT packet_id, timestamp, size, src_ip AS client_ip, dst_ip AS guard_ip FROM packets WHERE {_internal('src_ip')} AND dst_ip IN {_GUARDS}
      UNION ALL SELECT packet_id, timestamp, size, dst_ip, src_ip FROM packets WHERE {_internal('dst_ip')} AND src_ip IN {_GUARDS}),
    n AS (SELECT client_ip, guard_ip, count(*) AS packets, avg(size) AS mean_size FROM x GROUP BY ALL HAVING count(*) >= 12),
    se AS (SELECT client_ip, guard_ip, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS size_entropy FROM (SELECT client_ip, guard_ip, size, count(*)::DOUBLE AS c FROM x GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT client_ip, guard_ip, gap FROM (SELECT client_ip, guard_ip, timestamp - lag(timestamp) OVER (PARTITION BY client_ip, guard_ip ORDER BY timestamp, packet_id) AS gap FROM x) WHERE gap > 0),
    bi AS (SELECT client_ip, guard_ip, avg((gap < 0.01)::INT) AS burst, avg((gap > 2.0)::INT) AS idle FROM g GROUP BY ALL), {_GAP_ENTROPY.format(k='client_ip, guard_ip')},
    y AS (SELECT n.*, size_entropy, coalesce(gap_entropy, 0.0) AS gap_entropy, coalesce(burst, 0.0) AS burst, coalesce(idle, 0.0) AS idle FROM n JOIN se USING (client_ip, guard_ip) LEFT JOIN bi USING (client_ip, guard_ip) LEFT JOIN ge USING (client_ip, guard_ip))
    SELECT client_ip, guard_ip, packets, round(size_entropy, 4) AS size_entropy, round(gap_entropy, 4) AS gap_entropy, round(burst, 4) AS burst, round(idle, 4) AS idle, round(mean_size, 1) AS mean_size,
      CASE WHEN burst > 0.3 AND idle > 0.2 THEN 'interactive' WHEN size_entropy < 3 AND idle < 0.05 AND packets > 100 THEN 'bulk_download' WHEN gap_entropy < 3 AND size_entropy > 3 AND size_entropy < 5 THEN 'streaming'
        WHEN gap_entropy < 2 AND mean_size < 200 THEN 'c2_beacon' WHEN mean_size > 1000 AND burst > 0.5 THEN 'file_transfer' ELSE 'unknown' END AS kind,
      md5(concat_ws('|', floor(size_entropy * 100 + 0.5)::BIGINT, floor(gap_entropy * 100 + 0.5)::BIGINT, floor(burst * 100 + 0.5)::BIGINT, floor(idle * 100 + 0.5)::BIGINT, floor(mean_size * 100 + 0.5)::BIGINT)) AS fingerprint FROM y""",
)


def _events(spark, sf_dir):
    return circuits.relay_events(fixtures.flows(spark, sf_dir), fixtures.packets(spark, sf_dir))


_add("relay_events", _events)
_add("relay_users", lambda spark, sf_dir: circuits.relay_users(_events(spark, sf_dir)))
_add("relay_dashboard", lambda spark, sf_dir: circuits.relay_dashboard(_events(spark, sf_dir)))

# -- fingerprints

_NAMED = "coalesce(malware, 'Unknown') AS app, CASE WHEN malware IS NULL THEN 'unknown' ELSE 'malware' END AS type, CASE WHEN malware IS NULL THEN 'low' ELSE 'critical' END AS risk"
_add(
    "ja3_fingerprints",
    _on("flows", fingerprints.ja3_fingerprints),
    duck("flows") + f""", x AS (SELECT ja3, count(*) AS flows, min(start_time) AS first_seen, max(start_time) AS last_seen, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations, count(DISTINCT sni) AS names,
      coalesce(array_to_string(list_sort(list(DISTINCT sni) FILTER (sni IS NOT NULL))[1:10], ','), '') AS some_names FROM flows WHERE ja3 IS NOT NULL GROUP BY ja3)
    SELECT x.*, {_NAMED} FROM x LEFT JOIN {_MALWARE} USING (ja3)""",
)
_add(
    "ssh_fingerprints",
    _on("flows", lambda f: fingerprints.hassh_fingerprints(f, infer=True)),
    duck("flows") + """ SELECT md5(concat(src_ip, dst_port, total_bytes)) AS hassh, count(*) AS flows, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations, min(start_time) AS first_seen,
      'Unknown' AS app, 'unknown' AS type, 'low' AS risk FROM flows WHERE dst_port IN (22, 2222, 222, 2200, 22222) OR protocol = 'SSH' GROUP BY 1""",
)
_add(
    "fingerprint_correlation",
    _on("flows", fingerprints.correlate_fingerprints),
    duck("flows") + f""", x AS (SELECT src_ip AS ip, count(DISTINCT ja3) AS fingerprints, bool_or(malware IS NOT NULL) AS bad, bool_or(dst_port IN (22, 2222, 222, 2200, 22222) OR protocol = 'SSH') AS ssh FROM flows LEFT JOIN {_MALWARE} USING (ja3) GROUP BY ALL)
    SELECT ip, 'many_fingerprints' AS kind, fingerprints FROM x WHERE fingerprints > 5 UNION ALL SELECT ip, 'malware_client', fingerprints FROM x WHERE bad UNION ALL SELECT ip, 'malware_and_ssh', fingerprints FROM x WHERE bad AND ssh""",
)


# -- correlation of detectors

_ON_PACKETS = {"beacons": traffic.detect_beacons, "dns_tunnels": lambda p: dns.detect_dns_tunnel(p, 5, 1.0), "ttl_anomalies": traffic.detect_ttl_anomalies}
_ON_FLOWS = {"dga_domains": traffic.detect_dga, "exfiltration": lambda f: traffic.detect_exfil(f, 1e6, 10.0), "relay_flows": relay.match_relay_nodes, "internal_scans": lateral.detect_scans}


def _detected(spark, sf_dir):
    """Alerts of the detectors, with the parameters of their own queries.  Flows and
    packets are derived once and the alerts written once, however often they are read."""
    p = stored(fixtures.packets(spark, sf_dir).select("packet_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size", "ttl", "dns_query", "dns_type"))
    f = stored(fixtures.flows(spark, sf_dir).select("flow_id", "src_ip", "dst_ip", "dst_port", "start_time", "total_bytes", "sni"))
    found = {d: run(p) for d, run in _ON_PACKETS.items()} | {d: run(f) for d, run in _ON_FLOWS.items()}
    return stored(correlation.detector_alerts(found))


def _over(f):
    return lambda spark, sf_dir: f(_detected(spark, sf_dir))


_S = catalog.oracle_sql()
_DA = f"""WITH da AS (
  SELECT 'beacons' AS engine, 'c2' AS category, src_ip, dst_ip, CASE WHEN confidence = 'HIGH' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CASE WHEN confidence = 'HIGH' THEN 80.0e0 ELSE 60.0e0 END AS score, 'T1071.001' AS technique FROM ({_S['beacons']})
  UNION ALL SELECT 'dga_domains', 'c2', src_ip, NULL, CASE WHEN score > 0.8 THEN 'HIGH' ELSE 'MEDIUM' END, round(score * 80, 4), 'T1568' FROM ({_S['dga_domains']})
  UNION ALL SELECT 'exfiltration', 'exfiltration', src_ip, dst_ip, CASE WHEN ratio > 50 THEN 'CRITICAL' ELSE 'HIGH' END, round(least(95.0e0, 50 + ratio), 4), 'T1041' FROM ({_S['exfiltration']})
  UNION ALL SELECT 'relay_flows', 'tor', src_ip, relay_ip, 'HIGH', 60.0e0, 'T1090.003' FROM ({_S['relay_flows']})
  UNION ALL SELECT 'internal_scans', 'lateral', src_ip, dst_ip, severity, round(score::DOUBLE, 4), 'T1046' FROM ({_S['internal_scans']})
  UNION ALL SELECT 'dns_tunnels', 'dns_tunnel', src_ip, NULL, 'HIGH', round(score::DOUBLE, 4), 'T1071.004' FROM ({_S['dns_tunnels']})
  UNION ALL SELECT 'ttl_anomalies', 'evasion', src_ip, NULL, 'MEDIUM', 40.0e0, 'T1205' FROM ({_S['ttl_anomalies']}))"""
_STAGE = "CASE category " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in correlation.CATEGORY_STAGE.items()) + " END"
_RANK = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(correlation.CATEGORY_STAGE)) + " END"
_UN = _DA + f""", u AS (SELECT src_ip AS ip, * FROM da WHERE src_ip IS NOT NULL UNION ALL SELECT dst_ip, * FROM da WHERE dst_ip IS NOT NULL AND dst_ip IS DISTINCT FROM src_ip),
  g AS (SELECT ip, count(*) AS alerts, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques, arg_min(category, ({_RANK}, category)) AS category,
    round(least(100.0e0, max(score) + least(20, 8 * (count(DISTINCT engine) - 1))), 1) AS score FROM u GROUP BY ip HAVING count(*) >= 2 OR max(score) >= 80),
  un AS (SELECT substr(md5(concat(ip, ':', engines)), 1, 12) AS threat_id, *, {_STAGE} AS stage, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM g)"""
_TT = "(VALUES " + ", ".join(f"('{k}', '{n}', '{t}', {correlation.TACTICS.index(t)})" for k, (n, t) in correlation.TECHNIQUES.items()) + ") tt(technique, name, tactic, tactic_order)"
_SR = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"

_add("detector_alerts", _detected, _DA + " SELECT * FROM da")
_add("correlated_threats", _over(correlation.unify), _UN + " SELECT * FROM un")
_add("correlation_summary", _over(lambda a: correlation.summary(correlation.unify(a))), _UN + " SELECT severity, category, count(*) AS threats, round(avg(score), 4) AS mean_score FROM un GROUP BY ALL")
_add("campaigns", _over(lambda a: correlation.campaigns(a, correlation.unify(a))))
_add(
    "technique_map",
    _over(correlation.technique_map),
    _DA + f""", x AS (SELECT technique, count(*) AS alerts, count(DISTINCT src_ip) AS sources, max(score) AS score, max({_SR}) AS severity_rank, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines FROM da GROUP BY technique)
    SELECT x.*, name, tactic, tactic_order FROM x JOIN {_TT} USING (technique)""",
)
_add(
    "tactic_coverage",
    _over(correlation.tactic_coverage),
    _DA + f""", s AS (SELECT technique, count(*) AS n FROM da GROUP BY technique) SELECT tactic, tactic_order, count(*) AS known, count(n) AS seen, coalesce(sum(n), 0)::BIGINT AS alerts,
    coalesce(string_agg(CASE WHEN n > 0 THEN technique END, ',' ORDER BY technique), '') AS techniques FROM {_TT} LEFT JOIN s USING (technique) GROUP BY ALL""",
)
_add("navigator_layer", _over(correlation.navigator_layer))
_add(
    "attack_chains",
    _over(correlation.attack_chains),
    _DA + f""", x AS (SELECT *, CASE WHEN technique = 'T1046' THEN 'reconnaissance' ELSE {_STAGE} END AS stage FROM da),
    y AS (SELECT *, list_position({list(correlation.STAGES)}, stage) AS pos FROM x WHERE stage IS NOT NULL),
    g AS (SELECT src_ip AS ip, count(DISTINCT stage) AS n_stages, max(pos) - min(pos) + 1 AS span, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM y GROUP BY ip)
    SELECT substr(md5(concat('chain:', ip)), 1, 10) AS chain_id, ip, n_stages, stages, techniques, least(100, n_stages * 15 + span * 10) AS score, round(least(1.0, n_stages / 5), 4) AS confidence FROM g WHERE n_stages >= 2""",
)
_add("risk_report", _over(lambda a: correlation.risk_report(correlation.unify(a))), _UN + """ SELECT count(*) AS threats, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
    count(*) FILTER (severity = 'LOW') AS low, max(score) AS top, CASE WHEN max(score) >= 90 THEN 'CRITICAL' WHEN max(score) >= 70 THEN 'HIGH' WHEN max(score) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM un""")
_add("stix_objects", _over(lambda a: correlation.to_stix(correlation.unify(a))))


def _signals(spark, sf_dir):
    return correlation.flow_signals(fixtures.flows(spark, sf_dir), _detected(spark, sf_dir), R.malware_ja3(spark))


def _hunt(spark, sf_dir):
    return correlation.hunt(correlation.attack_chains(_detected(spark, sf_dir)), correlation.hypotheses(_signals(spark, sf_dir)), hunting.hunt_outliers(fixtures.flows(spark, sf_dir)))


_add("hypotheses", lambda spark, sf_dir: correlation.hypotheses(_signals(spark, sf_dir)))
_add("hunt_findings", _hunt)
_add("iocs", lambda spark, sf_dir: correlation.iocs(_detected(spark, sf_dir), fixtures.flows(spark, sf_dir)))
_add(
    "similar_flows",
    _on("flows", correlation.similar_flows),
    duck("flows") + """, x AS (SELECT *, floor(start_time / 3600) AS h, row_number() OVER (PARTITION BY dst_port, floor(start_time / 3600) ORDER BY start_time, flow_id) AS r, packet_count::DOUBLE AS p, total_bytes / 1e6 AS b, session_duration AS d, dst_port / 65535 AS q FROM flows),
    s AS (SELECT a.flow_id AS flow_a, b.flow_id AS flow_b, round((a.p * b.p + a.b * b.b + a.d * b.d + a.q * b.q) / (sqrt(a.p * a.p + a.b * a.b + a.d * a.d + a.q * a.q) * sqrt(b.p * b.p + b.b * b.b + b.d * b.d + b.q * b.q)), 4) AS similarity
      FROM x a JOIN x b ON a.dst_port = b.dst_port AND a.h = b.h AND b.r > a.r AND b.r <= a.r + 49) SELECT * FROM s WHERE similarity >= 0.95""",
)

# -- triage

_add(
    "triage",
    _alerts(lambda a: correlation.triage(a).select("alert_id", "status", "assignee", F.array_join("tags", ",").alias("tags"), F.array_join("actions", ",").alias("actions"))),
    _AL + """ SELECT alert_id, CASE WHEN threat_score > 85 THEN 'triaged' WHEN severity = 'INFO' THEN 'resolved' WHEN severity = 'CRITICAL' THEN 'escalated' ELSE status END AS status,
    CASE WHEN threat_score > 85 THEN 'senior_analyst' ELSE assignee END AS assignee, '' AS tags, concat_ws(',', CASE WHEN severity = 'CRITICAL' THEN 'escalate=soc_manager' END, CASE WHEN severity = 'INFO' THEN 'auto_close=auto_triaged' END, CASE WHEN threat_score > 85 THEN 'auto_assign=senior_analyst' END) AS actions FROM al""",
)


def _changes(a):
    """Two states of each alert: new when it was made, then its status."""
    return a.select("alert_id", F.lit("new").alias("status"), F.col("created").alias("at")).unionByName(a.where("status <> 'new'").select("alert_id", "status", (F.col("created") + 60).alias("at")))


_CH = _AL + ", ch AS (SELECT alert_id, 'new' AS status, created AS \"at\" FROM al UNION ALL SELECT alert_id, status, created + 60 FROM al WHERE status <> 'new')"
_add("state_changes", _alerts(lambda a: correlation.check_transitions(_changes(a))), _CH + ", b AS (SELECT *, lag(status) OVER (PARTITION BY alert_id ORDER BY \"at\") AS before FROM ch) SELECT *, CASE WHEN before IS NULL THEN status = 'new' ELSE status IN ('triaged', 'resolved') END AS valid FROM b")
_add("latest_states", _alerts(lambda a: correlation.latest_states(_changes(a))), _CH + " SELECT alert_id, arg_max(status, \"at\") AS status, max(\"at\") AS \"at\" FROM ch GROUP BY alert_id")
_add(
    "related_alerts",
    _alerts(lambda a: correlation.related_alerts(a.withColumn("techniques", F.array(F.concat(F.lit("T"), F.substr("alert_id", F.lit(2)).cast("long") % 9))))),
    _AL + """, x AS (SELECT alert_id, session_id, src_ip, dst_ip, category, substr(alert_id, 2)::BIGINT % 9 AS technique FROM al),
    p AS (SELECT a.alert_id, b.alert_id AS related_id, 3 * (a.session_id = b.session_id)::INT + 2 * (a.src_ip = b.src_ip)::INT + (a.src_ip IN (b.src_ip, b.dst_ip))::INT + (a.dst_ip <> a.src_ip AND a.dst_ip IN (b.src_ip, b.dst_ip))::INT + 2 * (a.category = b.category)::INT + 2 * (a.technique = b.technique)::INT AS s
      FROM x a JOIN x b ON a.alert_id <> b.alert_id),
    q AS (SELECT alert_id, unnest(min(((10 - s), related_id), 10)) AS r, generate_subscripts(min(((10 - s), related_id), 10), 1)::INT AS place FROM p WHERE s >= 3 GROUP BY alert_id)
    SELECT alert_id, r[2] AS related_id, round((10 - r[1]) / 10.0e0, 2) AS score, place FROM q""",
)
_add(
    "event_timeline",
    _alerts(lambda a: correlation.event_timeline(a.withColumn("threat_score", F.floor("threat_score")), width=86400)),
    _AL + """ SELECT floor((created - (SELECT min(created) FROM al)) / 86400)::BIGINT AS bucket, count(*) AS events, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
    count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, round(avg(floor(threat_score)), 4) AS mean_score FROM al GROUP BY 1""",
)


# -- features and domain model

_L = "lower(split_part(sni, '.', 1))"
_CONS = "[bcdfghjklmnpqrstvwxyz]"
_add(
    "domain_model",
    _on("flows", lambda f: features.domain_model(f, "sni")),
    duck("flows") + f""", a AS (SELECT DISTINCT sni AS domain, {_L} AS l, length({_L}) AS n FROM flows WHERE sni IS NOT NULL),
    g AS (SELECT *, list_transform(range(1, n), lambda i: substr(l, i, 2)) AS b, list_transform(range(1, n - 1), lambda i: substr(l, i, 3)) AS t FROM a),
    m AS (SELECT *, round({catalog._entropy('l')}, 4) AS e, round(1 - len(list_filter(b, lambda v: v IN {tuple(features.BIGRAMS)})) / greatest(len(b), 1), 4) AS bi, round(length(regexp_replace(l, '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / n, 4) AS co,
      round(length(regexp_replace(l, '[^0-9]', '', 'g')) / n, 4) AS di, round(least(1.0e0, greatest(0.0e0, (n - 8) / 20)), 4) AS le, round(least(1.0e0, coalesce(list_max(list_transform(regexp_extract_all(l, '{_CONS}+'), lambda v: length(v))), 0) / 5), 4) AS ru,
      round(len(list_distinct(string_split(l, ''))) / n, 4) AS un, round(len(list_distinct(t)) / greatest(len(t), 1), 4) AS tr FROM g),
    s AS (SELECT *, CASE WHEN n < 3 THEN 0.0e0 ELSE round(least(1.0e0, 0.2e0 * e + 0.2e0 * bi + 0.1e0 * co + 0.15e0 * di + 0.1e0 * le + 0.1e0 * ru + 0.05e0 * (1 - un) + 0.1e0 * tr + CASE WHEN e > 3.5 AND co > 0.65 THEN 0.15e0 ELSE 0.0e0 END + CASE WHEN di > 0.3 THEN 0.1e0 ELSE 0.0e0 END), 4) END AS score FROM m)
    SELECT domain, score, score >= 0.55 AS is_dga, CASE WHEN score < 0.55 THEN 'benign' WHEN di > 0.5 THEN 'conficker' WHEN n > 20 AND e > 4 THEN 'necurs' WHEN co > 0.75 THEN 'cryptolocker' WHEN bi > 0.8 THEN 'suppobox' ELSE 'unknown_dga' END AS kind,
      CASE WHEN score > 0.8 THEN 'HIGH' WHEN score > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s""",
)
_FAN = """e AS (SELECT DISTINCT src_ip, dst_ip FROM flows), fm AS (SELECT ip, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT src_ip AS ip, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst_ip, 0, 1 FROM e) GROUP BY ip)"""
_add("fan_metrics", _on("flows", features.fan_metrics), duck("flows") + f", {_FAN} SELECT *, round(least(1.0e0, 10 * fan_in * fan_out / ((SELECT count(*) FROM fm) ** 2)), 4) AS betweenness FROM fm")
_add(
    "movement_scores",
    _on("flows", features.movement_scores),
    duck("flows") + f""", f AS (SELECT * FROM flows WHERE {_internal('src_ip')} AND {_internal('dst_ip')}), o AS (SELECT src_ip AS ip, count(DISTINCT dst_ip) AS fan_out, avg((dst_port IN {tuple(R.ADMIN_PORTS)})::INT) AS admin FROM f GROUP BY 1),
    i AS (SELECT dst_ip AS ip, count(DISTINCT src_ip) AS fan_in FROM f GROUP BY 1), x AS (SELECT ip, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, coalesce(admin, 0.0e0) AS admin FROM o FULL JOIN i USING (ip))
    SELECT ip, fan_out, fan_in, round(admin, 4) AS admin_ratio, round(0.3e0 * least(1.0e0, fan_out / 30) + 0.3e0 * admin + 0.3e0 * CASE WHEN fan_out > 0 AND fan_in > 0 THEN 1.0e0 ELSE 0.0e0 END + 0.1e0 * least(1.0e0, fan_in / 10), 4) AS score FROM x""",
)
_add("timing_features", _on("packets", lambda p: features.timing(traffic.with_flow_id(p), ["flow_id"])))


def _endpoints(spark, sf_dir):
    """Their features; flows and packets are derived and written once."""
    flows = stored(fixtures.flows(spark, sf_dir).select("src_ip", "dst_ip", "dst_port", "protocol", "session_duration", "packet_count", "total_bytes", "tls_version", "ja3"))
    return features.endpoint_features(flows, stored(fixtures.packets(spark, sf_dir).select("packet_id", "timestamp", "src_ip", "size")))


_add("endpoint_features", _endpoints)
_add("timing_sequences", _on("packets", lambda p: features.timing_sequences(traffic.with_flow_id(p))))
_add("endpoint_clusters", lambda spark, sf_dir: features.clusters(_endpoints(spark, sf_dir), "src_ip", ["total_bytes", "total_packets", "port_entropy", "tls_ratio"]))

# -- graph


def _c2(spark, sf_dir):
    e = stored(graph.build_edges(fixtures.flows(spark, sf_dir)))
    alerts = _detected(spark, sf_dir)
    return graph.c2_candidates(e, graph.page_rank(e), graph.betweenness(e), alerts.where("engine = 'beacons'"), alerts.where("severity = 'CRITICAL'").select(F.col("src_ip").alias("ip")))


def _communities(spark, sf_dir):
    e = graph.build_edges(fixtures.flows(spark, sf_dir))
    return graph.community_profiles(e, graph.label_propagation(e), _detected(spark, sf_dir).where("severity = 'CRITICAL'").select(F.col("src_ip").alias("ip")))


_add("betweenness", _on("flows", lambda f: graph.betweenness(graph.build_edges(f))))
_add("node_roles", _on("flows", lambda f: graph.node_roles(graph.build_edges(f), graph.betweenness(graph.build_edges(f)))))
_add("c2_candidates", _c2)
_add("community_profiles", _communities)
_add("components", _on("flows", lambda f: graph.connected_components(graph.build_edges(f))))


# -- views

_add(
    "session_summary",
    _on("flows", views.session_summary),
    duck("flows") + """ SELECT session_id, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes, sum(packet_count)::BIGINT AS packets, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations, count(*) FILTER (protocol = 'TLS') AS tls_flows,
    count(*) FILTER (protocol = 'DNS') AS dns_flows, count(DISTINCT sni) AS names, count(DISTINCT ja3) AS fingerprints, min(start_time) AS first_seen, max(start_time + session_duration) AS last_seen FROM flows GROUP BY session_id""",
)
_add("severity_breakdown", _over(views.severity_breakdown), _DA + " SELECT severity, count(*) AS alerts, max(score) AS top_score, count(DISTINCT technique) AS techniques FROM da GROUP BY severity")
_add("top_techniques", _over(views.top_techniques), _DA + " SELECT technique, count(*) AS alerts FROM da GROUP BY technique ORDER BY alerts DESC, technique LIMIT 10")
_add("category_timeline", _alerts(views.category_timeline), _AL + " SELECT (floor(created / 60) * 60)::BIGINT AS bucket, category, severity, count(*) AS alerts FROM al GROUP BY ALL")
_add("fingerprint_names", _on("flows", views.fingerprint_names), duck("flows") + " SELECT ja3, sni, tls_version, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes FROM flows WHERE ja3 IS NOT NULL GROUP BY ALL")
_add(
    "endpoint_matrix",
    _on("flows", views.endpoint_matrix),
    duck("flows") + """, x AS (SELECT src_ip, sum(total_bytes)::BIGINT AS b, count(*) AS f, count(DISTINCT dst_ip) AS d, count(DISTINCT dst_port) AS p FROM flows GROUP BY src_ip),
    m AS (SELECT src_ip, b, round(b / max(b) OVER (), 4) AS bytes, round(f / max(f) OVER (), 4) AS flows, round(d / max(d) OVER (), 4) AS destinations, round(p / max(p) OVER (), 4) AS ports FROM x)
    SELECT src_ip, bytes, flows, destinations, ports FROM m ORDER BY b DESC, src_ip LIMIT 30""",
)


# -- SQL of queries that put others together

_SQL["navigator_layer"] = f"""SELECT technique, concat('{{"techniqueID":"', technique, '","score":', CASE WHEN severity_rank >= 3 THEN 100 WHEN severity_rank = 2 THEN 50 ELSE 25 END, ',"comment":"', engines, '"}}') AS line FROM ({_SQL["technique_map"]})"""
_RELAYS = "(" + ", ".join(f"'{k}'" for k in R.RELAY_NODES) + ")"
_SQL["relay_chains"] = duck("flows") + f""", x AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY start_time, flow_id) AS i FROM flows WHERE {_internal('src_ip')} AND (dst_ip IN {_RELAYS} OR dst_port IN {circuits.RELAY_PORTS})),
    l AS (SELECT src_ip, flow_id, list({{'t': start_time, 'd': dst_ip, 'p': packet_count::BIGINT, 'b': total_bytes}}) OVER (PARTITION BY src_ip ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS ahead FROM x),
    c AS (SELECT src_ip, flow_id, list_reduce(list_prepend([ahead[1]], list_transform(ahead[2:], lambda e: [e])),
      lambda a, e: CASE WHEN e[1].t - a[-1].t > 0.01 AND e[1].t - a[-1].t < 8 AND len(list_filter(a, lambda h: h.d = e[1].d)) = 0 THEN list_concat(a, e) ELSE a END) AS c FROM l),
    h AS (SELECT *, array_to_string(list_transform(c, lambda h: h.d), ',') AS hops FROM c WHERE len(c) >= 3)
    SELECT substr(md5(concat_ws(':', src_ip, hops, flow_id)), 1, 12) AS chain_id, src_ip, hops, len(c)::INT AS n_hops, c[1].d AS guard_ip, c[-1].d AS exit_ip, c[1].t AS start_time, round((c[-1].t - c[1].t) * 1000, 1) AS build_ms,
      list_sum(list_transform(c, lambda h: h.p))::BIGINT AS packets, list_sum(list_transform(c, lambda h: h.b))::BIGINT AS bytes FROM h"""
_SQL["circuit_stats"] = f"""SELECT count(*) AS circuits, round(avg(n_hops), 4) AS mean_hops, round(avg(build_ms), 4) AS mean_build_ms, count(*) FILTER (n_hops >= 5) AS extended FROM ({_SQL["relay_chains"]})"""
_SQL["iocs"] = _DA + f""", al AS (SELECT src_ip AS ip FROM da WHERE src_ip IS NOT NULL UNION ALL SELECT dst_ip FROM da WHERE dst_ip IS NOT NULL AND dst_ip IS DISTINCT FROM src_ip),
    fl AS ({duck("flows")} SELECT * FROM flows), f AS (SELECT * FROM fl WHERE src_ip IN (SELECT ip FROM al) AND dst_ip IN (SELECT ip FROM al))
    SELECT 'ip' AS kind, ip AS value, count(*) AS n FROM al WHERE NOT {_internal('ip')} GROUP BY ip UNION ALL SELECT 'domain', sni, count(*) FROM f WHERE sni IS NOT NULL GROUP BY sni UNION ALL SELECT 'ja3', ja3, count(*) FROM f WHERE ja3 IS NOT NULL GROUP BY ja3"""
_SQL["relay_events"] = f"""WITH m AS ({_S["relay_flows"]}), fl AS ({duck("flows")} SELECT flow_id, start_time FROM flows),
    g AS (SELECT src_ip, relay_ip, start_time - lag(start_time) OVER (PARTITION BY src_ip, relay_ip ORDER BY start_time, flow_id) AS gap FROM m JOIN fl USING (flow_id)),
    s AS (SELECT src_ip, relay_ip, round(stddev_samp(gap) / avg(gap), 4) AS cv FROM g WHERE gap > 0 AND gap < 7200 GROUP BY ALL HAVING count(*) >= 4 AND avg(gap) > 10),
    n AS (SELECT src_ip, relay_ip FROM m GROUP BY ALL HAVING count(*) >= 5),
    e AS (SELECT src_ip, dst_ip, 'relay_flow' AS kind, node_type AS subkind, 70.0::DOUBLE AS score FROM m
      UNION ALL SELECT src_ip, dst_ip, 'cell_sizes', 'cells', round(50 + 40 * cell_ratio, 4) FROM ({_S["relay_cells"]})
      UNION ALL SELECT src_ip, relay_ip, 'relay_c2', 'steady', round(90 - 50 * cv, 4) FROM s JOIN n USING (src_ip, relay_ip) WHERE cv < 0.35
      UNION ALL SELECT src_ip, relay_ip, 'relay_traffic', kind, 60.0 FROM ({_SQL["relay_traffic_classes"]}) WHERE kind <> 'general')
    SELECT src_ip, dst_ip, kind, subkind, max(score) AS score, count(*) AS findings FROM e GROUP BY ALL"""
_SQL["relay_users"] = f"""SELECT src_ip AS ip, count(*) AS events, count(DISTINCT dst_ip) AS relays, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(score) AS score FROM ({_SQL["relay_events"]}) WHERE {_internal('src_ip')} GROUP BY src_ip"""
_SQL["relay_dashboard"] = f"""SELECT kind, subkind, count(*) AS events, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations, max(score) AS score FROM ({_SQL["relay_events"]}) GROUP BY ALL"""
_SQL["timing_features"] = _PK + """, g AS (SELECT flow_id, timestamp, packet_id, gap FROM (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY flow_id ORDER BY timestamp, packet_id) AS gap FROM pf) WHERE gap > 0),
    h AS (SELECT *, lead(gap) OVER (PARTITION BY flow_id ORDER BY timestamp, packet_id) AS nx, avg(gap) OVER (PARTITION BY flow_id) AS m FROM g)
    SELECT flow_id, count(*) AS gaps, round(avg(gap), 4) AS mean_gap, round(coalesce(stddev_samp(gap), 0.0), 4) AS gap_deviation, round(coalesce(stddev_samp(gap) / avg(gap), 0.0), 4) AS gap_cv, round(coalesce(avg(abs(nx - gap)), 0.0), 4) AS jitter,
      round(CASE WHEN var_samp(gap) > 0 THEN coalesce(avg((gap - m) * (nx - m)) / var_samp(gap), 0.0) ELSE 0.0 END, 4) AS autocorrelation FROM h GROUP BY flow_id"""
_SQL["campaigns"] = _UN.replace("WITH", "WITH RECURSIVE", 1) + """, ce AS (SELECT DISTINCT src_ip AS a, dst_ip AS b FROM da WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL), cb AS (SELECT a, b FROM ce UNION SELECT b, a FROM ce),
    cr(n, c) AS (SELECT a, a FROM cb UNION SELECT cb.b, cr.c FROM cr JOIN cb ON cb.a = cr.n WHERE cr.c <= cb.b), co AS (SELECT n, min(c) AS component FROM cr GROUP BY n),
    tt AS (SELECT component, ip, score, unnest(string_split(techniques, ',')) AS t FROM un JOIN co ON n = ip)
    SELECT substr(md5(concat('campaign:', component)), 1, 12) AS campaign_id, component, count(DISTINCT ip) AS threats, string_agg(DISTINCT t, ',' ORDER BY t) AS techniques, max(score) AS score FROM tt GROUP BY component HAVING count(DISTINCT ip) >= 2 AND count(DISTINCT t) >= 3"""


_UID = r"concat('{k}--', regexp_replace(md5({v}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5'))"
_IND, _PAT, _TIE = (_UID.format(k=k, v=v) for k, v in (("indicator", "concat('ip:', ip)"), ("attack-pattern", "technique"), ("relationship", "concat(ip, ':', technique)")))


def _object(kind: str, name: str, body: str) -> str:
    return f"""SELECT {name} AS stix_id, '{kind}' AS type, concat('{{"type":"{kind}","spec_version":"2.1","id":"', {name}, '","created":"2024-01-01T00:00:00Z",', {body}, '}}') AS line"""


_PATTERN = """concat('"pattern":"[ipv4-addr:value = ', chr(39), ip, chr(39), ']","confidence":', trunc(max(score))::INT)"""
_TIED = f"""concat('"relationship_type":"indicates","source_ref":"', {_IND}, '","target_ref":"', {_PAT}, '"')"""
_NAMES_IT = """concat('"external_id":"', technique, '"')"""
_SQL["stix_objects"] = _UN + f""", st AS (SELECT DISTINCT ip, unnest(string_split(techniques, ',')) AS technique FROM un)
    {_object("indicator", _IND, _PATTERN)} FROM un GROUP BY ip
    UNION ALL {_object("attack-pattern", _PAT, _NAMES_IT)} FROM (SELECT DISTINCT technique FROM st)
    UNION ALL {_object("relationship", _TIE, _TIED)} FROM st"""


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
