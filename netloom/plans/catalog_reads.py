"""Queries of the reads and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import reads, traffic
from netloom.plans import catalog, fixtures
from netloom.plans.fixtures import duck

_Q, _SQL = {}, {}


def _add(name: str, query, sql: str) -> None:
    _Q[name], _SQL[name] = query, sql


def _alerts(f):
    return lambda spark, sf_dir: f(fixtures.alerts(spark, sf_dir).withColumn("threat_score", F.floor(F.col("price") / 1000)))


_AL = duck("alerts") + ", al AS (SELECT *, floor(price / 1000)::BIGINT AS threat_score FROM alerts)"
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 END::INT"

_add(
    "recent_packets",
    lambda spark, sf_dir: reads.recent_packets(fixtures.packets(spark, sf_dir), protocol="DNS", n=100).select("packet_id", "src_ip", "dst_ip", "protocol", "size", "dns_query"),
    duck("packets") + " SELECT packet_id, src_ip, dst_ip, protocol, size, dns_query FROM packets WHERE protocol = 'DNS' ORDER BY timestamp DESC, packet_id LIMIT 100",
)
_add(
    "query_alerts",
    _alerts(lambda a: reads.query_alerts(a, tenant="t1", statuses=("new", "triaged"), severities=("critical", "high"), category="EA", min_score=50, by="score").select("alert_id", "severity", "category", "assignee", "threat_score", "rank")),
    _AL + f" SELECT alert_id, severity, category, assignee, threat_score, {_RANK} AS rank FROM al WHERE tenant_id = 't1' AND status IN ('new', 'triaged') AND severity IN ('CRITICAL', 'HIGH') AND contains(category, 'ea') AND threat_score >= 50",
)
_add(
    "tenant_alerts",
    _alerts(lambda a: reads.of_tenant(a, "t2").select("alert_id", "tenant_id", "category", reads.severity_rank(F.col("severity")).alias("rank"))),
    _AL + f" SELECT alert_id, tenant_id, category, {_RANK} AS rank FROM al WHERE tenant_id = 't2'",
)
_add(
    "filter_threats",
    _alerts(lambda a: reads.filter_threats(a, 100, ("beacon", "dga"), ("CRITICAL", "HIGH"), score_col="threat_score").select("alert_id", "category", "severity", "threat_score")),
    _AL + " SELECT alert_id, category, severity, threat_score FROM al WHERE threat_score >= 100 AND category IN ('beacon', 'dga') AND severity IN ('CRITICAL', 'HIGH')",
)
_add("notify_rows", _alerts(reads.notify_rows), _AL + " SELECT alert_id, severity, format('[{}] {} from {} to {}', severity, category, src_ip, dst_ip) AS message FROM al WHERE severity IN ('CRITICAL', 'HIGH')")
_O = "list_transform(string_split(dst_ip, '.'), lambda x: x::INT)"
_add(
    "address_classes",
    lambda spark, sf_dir: fixtures.flows(spark, sf_dir).select("dst_ip").distinct().select("dst_ip", reads.address_class(F.col("dst_ip")).alias("kind")),
    duck("flows") + f", d AS (SELECT DISTINCT dst_ip, {_O} AS o FROM flows) SELECT dst_ip, CASE WHEN o[1] = 10 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) THEN 'private' WHEN o[1] = 127 THEN 'loopback' WHEN o[1] = 169 AND o[2] = 254 THEN 'link_local' WHEN o[1] BETWEEN 224 AND 239 THEN 'multicast' WHEN o[1] = 0 OR o[1] >= 240 THEN 'reserved' ELSE 'public' END AS kind FROM d",
)
_add(
    "packet_times",
    lambda spark, sf_dir: fixtures.packets(spark, sf_dir).select("packet_id", reads.iso_time(F.col("timestamp")).alias("at"), reads.code_name(F.when(F.col("protocol") == "DNS", F.col("size") % 30), reads.DNS_TYPES).alias("type")),
    duck("packets") + " SELECT packet_id, strftime(make_timestamp(round(timestamp * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%f') AS at, CASE WHEN protocol = 'DNS' THEN CASE size % 30 WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 5 THEN 'CNAME' WHEN 6 THEN 'SOA' WHEN 12 THEN 'PTR' WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT' WHEN 28 THEN 'AAAA' ELSE (size % 30)::VARCHAR END END AS type FROM packets",
)
_add(
    "merged_alerts",
    _alerts(reads.merge_open_alerts),
    _AL + """, k AS (SELECT *, md5(concat_ws('|', category, array_to_string(list_sort([src_ip, dst_ip]), ','), category)) AS key FROM al WHERE status <> 'resolved'),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created DESC, alert_id) AS place FROM k)
    SELECT key, arg_min(alert_id, (created, alert_id)) AS alert_id, max(threat_score) AS threat_score, count(*) AS n_alerts, string_agg(alert_id, ',' ORDER BY place) FILTER (place <= 3) AS evidence FROM r GROUP BY key""",
)
_add(
    "alerts_from_threats",
    lambda spark, sf_dir: reads.threats_to_alerts(fixtures.flows(spark, sf_dir).groupBy("src_ip").agg((F.max("packet_count") / 50).alias("score")).select("src_ip", F.lit("volume").alias("category"), "score", F.when(F.col("score") >= 0.9, "HIGH").otherwise("LOW").alias("severity")), "volume", "t1"),
    duck("flows") + ", x AS (SELECT src_ip, max(packet_count) / 50 AS s FROM flows GROUP BY 1) SELECT substr(md5(concat('t1|volume|volume|', src_ip)), 1, 16) AS alert_id, 't1' AS tenant_id, 'volume' AS engine, src_ip, 'volume' AS category, CASE WHEN s >= 0.9 THEN 'HIGH' ELSE 'LOW' END AS severity, round(s * 100, 2) AS threat_score, 'new' AS status FROM x",
)
_add(
    "name_addresses",
    lambda spark, sf_dir: reads.name_addresses(fixtures.flows(spark, sf_dir)),
    duck("flows") + ", p AS (SELECT lower(sni) AS name, dst_ip AS address, count(*) AS flows FROM flows WHERE sni IS NOT NULL GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY address) AS names, count(*) OVER (PARTITION BY name) AS addresses FROM p",
)
_add(
    "reputation",
    lambda spark, sf_dir: reads.reputation(fixtures.flows(spark, sf_dir).select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()).select("ip", "risk", "flags"),
    duck("flows") + ", d AS (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows), x AS (SELECT ip, starts_with(ip, '10.') AS i, CASE WHEN starts_with(ip, '185.220.') THEN '^185\\.220\\.' ELSE '' END AS flags FROM d) SELECT ip, flags, CASE WHEN i THEN 'internal' WHEN flags <> '' THEN 'high' ELSE 'unknown' END AS risk FROM x",
)
_add(
    "sessions",
    lambda spark, sf_dir: reads.sessions(fixtures.flows(spark, sf_dir), fixtures.alerts(spark, sf_dir)),
    duck("flows", "alerts") + ", a AS (SELECT session_id, count(*) AS alerts, count(*) FILTER (severity = 'CRITICAL') AS critical FROM alerts GROUP BY 1), f AS (SELECT session_id, min(start_time) AS started, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY 1) SELECT session_id, started, flows, bytes, coalesce(alerts, 0) AS alerts, coalesce(critical, 0) AS critical FROM f LEFT JOIN a USING (session_id) ORDER BY started DESC, session_id LIMIT 50",
)
_add(
    "tenant_overview",
    lambda spark, sf_dir: reads.tenant_overview(fixtures.flows(spark, sf_dir), fixtures.alerts(spark, sf_dir)),
    duck("flows", "alerts") + ", a AS (SELECT tenant_id, count(DISTINCT alert_id) AS alerts, count(*) FILTER (status <> 'resolved') AS open_alerts FROM alerts GROUP BY 1), f AS (SELECT tenant_id, count(DISTINCT src_ip) AS sources, count(DISTINCT session_id) AS sessions, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY 1) SELECT tenant_id, sources, sessions, bytes, coalesce(alerts, 0) AS alerts, coalesce(open_alerts, 0) AS open_alerts FROM f LEFT JOIN a USING (tenant_id)",
)


def _nodes(spark, sf_dir):
    f = fixtures.flows(spark, sf_dir)
    return reads.mark_nodes(traffic.graph_nodes(traffic.connection_graph(f, None)), traffic.profile_endpoints(f)).select("ip", "degree", "suspicious")


_add("marked_nodes", _nodes, f"SELECT n.ip, n.degree, coalesce(p.suspicion_score > 40, false) AS suspicious FROM ({catalog.oracle_sql()['graph_nodes']}) n LEFT JOIN ({catalog.oracle_sql()['endpoint_profiles']}) p ON n.ip = p.ip")


def _flags(spark, sf_dir):
    f, a = fixtures.flows(spark, sf_dir), fixtures.alerts(spark, sf_dir)
    ends = f.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    return reads.known_flags(ends, alerted=a.select(F.col("src_ip").alias("ip")), served=f.where("sni is not null").select(F.col("dst_ip").alias("ip")))


_add(
    "known_flags",
    _flags,
    duck("flows", "alerts") + " SELECT ip, EXISTS (SELECT 1 FROM alerts WHERE src_ip = d.ip) AS alerted, EXISTS (SELECT 1 FROM flows WHERE sni IS NOT NULL AND dst_ip = d.ip) AS served FROM (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows) d",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
