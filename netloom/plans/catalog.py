"""All registered queries of the network operators, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import dns, graph, hunting, lateral, models, relay, soc, tls, traffic
from netloom.operators import reference as R
from netloom.plans import fixtures
from netloom.plans.fixtures import duck

_Q: dict = {}
_SQL: dict = {}


def _add(name: str, run, sql: str | None = None) -> None:
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


def _on(which: str, f):
    """A query that applies ``f`` to one of the derived tables."""
    derive = {"flows": fixtures.flows, "packets": fixtures.packets, "alerts": fixtures.alerts}[which]
    return lambda spark, sf_dir: f(derive(spark, sf_dir))


def _internal(ip: str) -> str:
    return f"(regexp_matches({ip}, '^(10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])') OR {ip} = '127.0.0.1')"


def _entropy(x: str) -> str:
    n = f"length({x})::DOUBLE"
    counts = f"list_transform(list_distinct(string_split({x}, '')), lambda c: (length({x}) - length(replace({x}, c, '')))::DOUBLE)"
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 0.0 ELSE log2({n}) - list_sum(list_transform({counts}, lambda v: v * log2(v))) / {n} END)"


def _dga(x: str) -> str:
    label = f"split_part({x}, '.', 1)"
    cons = f"round(length(regexp_replace(lower({label}), '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / greatest(length({label}), 1), 3)"
    return f"round(least(1.0, CASE WHEN round({_entropy(label)}, 4) > 3.5 THEN 0.4 ELSE 0 END + CASE WHEN {cons} > 0.65 THEN 0.3 ELSE 0 END + CASE WHEN length({label}) > 12 THEN 0.2 ELSE 0 END + CASE WHEN length({label}) > 20 THEN 0.1 ELSE 0 END)::DOUBLE, 3)"


def _in(values) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


_MALWARE = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in R.MALWARE_JA3.items()) + ") m(ja3, malware)"
_ADMIN = "(VALUES " + ", ".join(f"({p}, '{n}', '{t}')" for p, (n, t) in R.ADMIN_PORTS.items()) + ") ap(dst_port, service, technique)"
_PK = duck("packets") + """,
pf AS (SELECT *, substr(md5(CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', protocol)
   ELSE concat(dst_ip, ':', dst_port, '-', src_ip, ':', src_port, '-', protocol) END), 1, 16) AS flow_id FROM packets)"""
_AGG = """,
af AS (SELECT flow_id, arg_min(src_ip, (timestamp, packet_id)) AS src_ip, arg_min(dst_ip, (timestamp, packet_id)) AS dst_ip, arg_min(src_port, (timestamp, packet_id)) AS src_port,
  arg_min(dst_port, (timestamp, packet_id)) AS dst_port, arg_min(protocol, (timestamp, packet_id)) AS protocol, min(timestamp) AS start_time, max(timestamp) AS end_time,
  count(*) AS packet_count, sum(size)::BIGINT AS total_bytes FROM pf GROUP BY flow_id)"""

# -- flows and traffic detectors

_add("flow_ids", _on("packets", lambda p: traffic.with_flow_id(p).select("packet_id", "flow_id")), _PK + " SELECT packet_id, flow_id FROM pf")
_add(
    "flow_aggregation",
    _on("packets", lambda p: traffic.aggregate_flows(p).withColumn("session_duration", F.round("session_duration", 3)).withColumn("avg_packet_size", F.round("avg_packet_size", 4))),
    _PK + _AGG + " SELECT *, round(end_time - start_time, 3) AS session_duration, round(total_bytes / packet_count, 4) AS avg_packet_size FROM af",
)
_add(
    "flow_timeouts",
    _on("packets", lambda p: traffic.aggregate_flows(p, 120.0).select("flow_id", "flow_part", "packet_count", "total_bytes", "start_time")),
    _PK + """, c AS (SELECT *, coalesce((timestamp - lag(timestamp) OVER w > 120.0)::INT, 0) AS cut FROM pf WINDOW w AS (PARTITION BY flow_id ORDER BY timestamp, packet_id)),
    s AS (SELECT *, (sum(cut) OVER (PARTITION BY flow_id ORDER BY timestamp, packet_id))::BIGINT AS flow_part FROM c)
    SELECT flow_id, flow_part, count(*) AS packet_count, sum(size)::BIGINT AS total_bytes, min(timestamp) AS start_time FROM s GROUP BY flow_id, flow_part""",
)
_add(
    "beacons",
    _on("packets", traffic.detect_beacons),
    _PK + _AGG + """, g AS (SELECT flow_id, timestamp - lag(timestamp) OVER (PARTITION BY flow_id ORDER BY timestamp, packet_id) AS gap FROM pf),
    s AS (SELECT flow_id, avg(gap) AS m, stddev_samp(gap) AS sd, count(*) AS k FROM g WHERE gap > 0.05 GROUP BY flow_id HAVING count(*) >= 3),
    x AS (SELECT s.*, af.*, CASE WHEN m > 0 THEN sd / m ELSE 1.0 END AS cv FROM s JOIN af ON s.flow_id = af.flow_id WHERE packet_count >= 5)
    SELECT flow_id, src_ip, dst_ip, dst_port, round(m, 3) AS interval_mean, round(sd, 3) AS interval_stdev, round(greatest(0.0, 1 - cv), 4) AS regularity, packet_count,
      CASE WHEN cv < 0.10 THEN 'HIGH' WHEN cv < 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
      CASE WHEN m < 10 THEN 'fast_beacon' WHEN m < 60 THEN 'short_beacon' WHEN m < 600 THEN 'medium_beacon' WHEN m < 3600 THEN 'slow_beacon' ELSE 'very_slow_beacon' END AS beacon_type
    FROM x WHERE cv < 0.40""",
)
_add(
    "bursts",
    _on("packets", traffic.detect_bursts),
    duck("packets") + """, pr AS (SELECT src_ip, dst_ip, count(*) AS n, max(timestamp) - min(timestamp) AS span FROM packets GROUP BY ALL HAVING count(*) >= 10 AND max(timestamp) - min(timestamp) >= 1),
    w AS (SELECT p.*, n, span, count(*) OVER v AS count, sum(size) OVER v AS bytes, min(timestamp) OVER v AS start FROM packets p JOIN pr USING (src_ip, dst_ip)
      WINDOW v AS (PARTITION BY src_ip, dst_ip ORDER BY timestamp RANGE BETWEEN 5.0 PRECEDING AND CURRENT ROW)),
    f AS (SELECT *, round_even(start, 0) AS second, count / 5.0e0 AS rate, n / span AS mean FROM w WHERE count / 5.0e0 > 3.0e0 * (n / span) AND count >= 5)
    SELECT src_ip, dst_ip, second, count, bytes::BIGINT AS bytes, round(rate / mean, 2) AS ratio, CASE WHEN rate > 5 * mean THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM f QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, second ORDER BY timestamp, packet_id) = 1""",
)
_add(
    "exfiltration",
    _on("flows", lambda f: traffic.detect_exfil(f, 1e6, 10.0)),
    duck("flows") + """, s AS (SELECT src_ip, dst_ip, sum(total_bytes)::BIGINT AS sent FROM flows GROUP BY ALL)
    SELECT a.src_ip, a.dst_ip, a.sent, b.sent AS received, round(a.sent / b.sent, 2) AS ratio FROM s a JOIN s b ON a.src_ip = b.dst_ip AND a.dst_ip = b.src_ip
    WHERE a.sent >= 1e6 AND b.sent > 0 AND a.sent / b.sent >= 10""",
)
_add(
    "ttl_anomalies",
    _on("packets", traffic.detect_ttl_anomalies),
    duck("packets") + """, c AS (SELECT src_ip, ttl, count(*) AS c FROM packets WHERE ttl > 0 GROUP BY ALL), d AS (SELECT src_ip, arg_min(ttl, (-c, ttl)) AS dominant_ttl FROM c GROUP BY ALL)
    SELECT src_ip, count(*) AS n, count(DISTINCT ttl) AS n_ttl, round(var_samp(ttl), 2) AS variance, any_value(dominant_ttl) AS dominant_ttl,
      CASE WHEN any_value(dominant_ttl) BETWEEN 60 AND 65 THEN 'Linux / Android' WHEN any_value(dominant_ttl) BETWEEN 126 AND 129 THEN 'Windows' WHEN any_value(dominant_ttl) BETWEEN 253 AND 256 THEN 'Cisco / network device'
        WHEN any_value(dominant_ttl) BETWEEN 30 AND 35 THEN 'Solaris / AIX' ELSE 'Unknown' END AS os_guess
    FROM packets JOIN d USING (src_ip) WHERE ttl > 0 GROUP BY src_ip HAVING count(*) >= 3 AND (count(DISTINCT ttl) > 3 OR round(var_samp(ttl), 2) > 100)""",
)
_add(
    "dga_domains",
    _on("flows", traffic.detect_dga),
    duck("flows") + f""", n AS (SELECT sni, arg_min(flow_id, (start_time, flow_id)) AS flow_id, arg_min(src_ip, (start_time, flow_id)) AS src_ip, count(*) AS n_flows FROM flows WHERE sni IS NOT NULL GROUP BY sni)
    SELECT sni, flow_id, src_ip, n_flows, {_dga('sni')} AS score, round({_entropy("split_part(sni, '.', 1)")}, 4) AS entropy,
      round(length(regexp_replace(lower(split_part(sni, '.', 1)), '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / length(split_part(sni, '.', 1)), 3) AS consonants FROM n WHERE {_dga('sni')} >= 0.6""",
)
_add(
    "endpoint_profiles",
    _on("flows", traffic.profile_endpoints),
    duck("flows") + f""", e AS (SELECT src_ip AS ip, dst_ip AS peer, true AS o, * FROM flows UNION ALL SELECT dst_ip, src_ip, false, * FROM flows WHERE src_ip <> dst_ip),
    pc AS (SELECT ip, dst_port, count(*)::DOUBLE AS c FROM e WHERE o GROUP BY ALL), pe AS (SELECT ip, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS pe FROM pc GROUP BY ip),
    g AS (SELECT ip, count(*) AS total_flows, sum(total_bytes)::BIGINT AS total_bytes, count(DISTINCT CASE WHEN o THEN peer END) AS fan_out, count(DISTINCT CASE WHEN NOT o THEN peer END) AS fan_in,
      sum(CASE WHEN o THEN total_bytes ELSE 0 END) AS ob, sum(CASE WHEN NOT o THEN total_bytes ELSE 0 END) AS ib, coalesce(avg(CASE WHEN session_duration > 0 THEN session_duration END), 0) AS d,
      avg((protocol = 'TLS')::INT) AS tls, bool_or(malware IS NOT NULL) AS mal, bool_or(coalesce({_dga('sni')}, 0) >= 0.6) AS dga, bool_or(o AND dst_port IN {_in(R.C2_PORTS)}) AS c2
      FROM e LEFT JOIN {_MALWARE} USING (ja3) GROUP BY ip),
    x AS (SELECT g.*, coalesce(pe, 0.0) AS pe, CASE WHEN ib > 0 THEN ob / ib ELSE 0.0 END AS ratio FROM g LEFT JOIN pe USING (ip)),
    r AS (SELECT *, list_filter([CASE WHEN mal THEN ('malware_ja3', 40) END, CASE WHEN fan_out > 50 THEN ('many_destinations', 20) END, CASE WHEN total_flows > 100 THEN ('many_flows', 10) END,
      CASE WHEN fan_out = 1 AND total_flows > 25 THEN ('one_destination', 20) END, CASE WHEN c2 THEN ('c2_ports', 20) END, CASE WHEN d < 2 AND total_flows > 15 THEN ('short_sessions', 10) END,
      CASE WHEN tls = 1 AND total_flows > 10 THEN ('all_tls', 5) END, CASE WHEN pe > 3.5 THEN ('port_entropy', 15) END, CASE WHEN ratio > 10 AND ob > 5000000 THEN ('exfiltration', 25) END,
      CASE WHEN dga THEN ('dga', 20) END], lambda v: v IS NOT NULL) AS rs FROM x)
    SELECT ip, total_flows, total_bytes, fan_out, fan_in, round(d, 2) AS avg_session_duration, round(tls, 3) AS tls_ratio, round(pe, 3) AS port_entropy, round(ratio, 2) AS exfil_ratio,
      least(100, coalesce(list_sum(list_transform(rs, lambda v: v[2])), 0))::INT AS suspicion_score, coalesce(array_to_string(list_transform(rs, lambda v: v[1]), ','), '') AS reasons FROM r""",
)
_LABEL = """CASE WHEN protocol = 'DNS' OR dst_port = 53 THEN 'dns_query' WHEN packet_count <= 3 AND session_duration < 0.5 THEN 'scan_probe'
  WHEN total_bytes / greatest(packet_count, 1) > 40000 AND session_duration > 5 THEN 'bulk_transfer' WHEN session_duration > 300 THEN 'persistent_session'
  WHEN packet_count > 80 AND total_bytes / greatest(packet_count, 1) < 500 THEN 'interactive' WHEN ja3 IS NOT NULL THEN 'tls_encrypted' ELSE 'standard' END AS label"""
_add("flow_labels", _on("flows", lambda f: traffic.label_flows(f).select("flow_id", "label")), duck("flows") + f" SELECT flow_id, {_LABEL} FROM flows")
_add(
    "flow_clusters",
    _on("flows", traffic.flow_clusters),
    duck("flows") + f""", l AS (SELECT *, {_LABEL} FROM flows), p AS (SELECT label, dst_port, count(*) AS c FROM l GROUP BY ALL), i AS (SELECT label, dst_ip, count(*) AS c FROM l GROUP BY ALL),
    a AS (SELECT label, arg_min(dst_port, (-c, dst_port)) AS dominant_port FROM p GROUP BY label), b AS (SELECT label, arg_min(dst_ip, (-c, dst_ip)) AS centroid_ip FROM i GROUP BY label)
    SELECT label, count(*) AS flow_count, round(avg(total_bytes), 0) AS avg_bytes, round(avg(session_duration), 2) AS avg_duration, any_value(dominant_port) AS dominant_port, any_value(centroid_ip) AS centroid_ip,
      (row_number() OVER (ORDER BY label) - 1)::INT AS cluster_id FROM l JOIN a USING (label) JOIN b USING (label) GROUP BY label""",
)

# -- aggregates

_add("protocol_stats", _on("flows", traffic.protocol_stats), duck("flows") + " SELECT protocol, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY protocol")
_add("top_sources", _on("flows", traffic.top_endpoints), duck("flows") + " SELECT src_ip, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY src_ip ORDER BY flows DESC, src_ip LIMIT 20")
_add("top_destinations", _on("flows", lambda f: traffic.top_endpoints(f, "dst_ip")), duck("flows") + " SELECT dst_ip, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY dst_ip ORDER BY flows DESC, dst_ip LIMIT 20")
_add("packet_timeline", _on("packets", traffic.timeline), duck("packets") + " SELECT (floor(timestamp / 60) * 60)::BIGINT AS bucket, count(*) AS packets, sum(size)::BIGINT AS bytes FROM packets GROUP BY 1")
_add(
    "ja3_stats",
    _on("flows", traffic.ja3_stats),
    duck("flows") + f", j AS (SELECT ja3, count(*) AS flows, arg_min(sni, (start_time, flow_id)) AS sni0, first(sni ORDER BY start_time, flow_id) AS sni, first(tls_version ORDER BY start_time, flow_id) AS tls_version FROM flows WHERE ja3 IS NOT NULL GROUP BY ja3) SELECT ja3, flows, sni, tls_version, malware FROM j LEFT JOIN {_MALWARE} USING (ja3) ORDER BY flows DESC, ja3 LIMIT 30",
)
_add("dns_stats", _on("packets", traffic.dns_stats), duck("packets") + f" SELECT dns_query, dns_type, count(*) AS queries, {_dga('dns_query')} AS dga_score FROM packets WHERE dns_query IS NOT NULL GROUP BY ALL ORDER BY queries DESC, dns_query LIMIT 50")
_add("connection_graph", _on("flows", traffic.connection_graph), duck("flows") + " SELECT src_ip, dst_ip, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes, arg_min(protocol, (start_time, flow_id)) AS protocol FROM flows GROUP BY ALL ORDER BY bytes DESC, src_ip, dst_ip LIMIT 200")
_add(
    "graph_nodes",
    _on("flows", lambda f: traffic.graph_nodes(traffic.connection_graph(f, None))),
    duck("flows") + f", e AS (SELECT DISTINCT src_ip, dst_ip FROM flows) SELECT ip, count(*) AS degree, {_internal('ip')} AS internal FROM (SELECT src_ip AS ip FROM e UNION ALL SELECT dst_ip FROM e) GROUP BY ip",
)
_add("shared_fingerprints", _on("flows", traffic.shared_fingerprints), duck("flows") + " SELECT ja3, count(DISTINCT src_ip) AS n_sources, count(*) AS flows FROM flows WHERE ja3 IS NOT NULL GROUP BY ja3 HAVING count(DISTINCT src_ip) > 1")
_add("shared_destinations", _on("flows", traffic.shared_destinations), duck("flows") + " SELECT dst_ip, count(DISTINCT src_ip) AS n_sources FROM flows GROUP BY dst_ip HAVING count(DISTINCT src_ip) > 2")
_add("repeated_sessions", _on("flows", traffic.repeated_sessions), duck("flows") + " SELECT src_ip, dst_ip, dst_port, count(*) AS sessions, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY ALL HAVING count(*) >= 5")
_add("unusual_ports", _on("flows", traffic.unusual_ports), duck("flows") + " SELECT dst_port, count(*) AS flows FROM flows WHERE dst_port NOT IN (80, 443, 53, 22) GROUP BY dst_port ORDER BY flows DESC, dst_port LIMIT 20")
_add("tenant_stats", _on("flows", traffic.tenant_stats), duck("flows") + " SELECT tenant_id, count(DISTINCT src_ip) AS endpoints, sum(total_bytes)::BIGINT AS bytes, count(*) AS flows FROM flows GROUP BY tenant_id")
_add("encryption_stats", _on("flows", traffic.encryption_stats), duck("flows") + f" SELECT count(*) FILTER (protocol = 'TLS' OR sni IS NOT NULL) AS encrypted, count(ja3) AS with_ja3, count(malware) AS malicious, count(*) AS flows FROM flows LEFT JOIN {_MALWARE} USING (ja3)")
_add("session_totals", _on("flows", traffic.session_totals), duck("flows") + " SELECT session_id, count(*) AS flows, sum(packet_count)::BIGINT AS packets, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY session_id")
_add("flows_page", _on("flows", lambda f: traffic.flows_page(f, protocol="tls", has_sni=True, page=2).select("flow_id", "start_time")), duck("flows") + " SELECT flow_id, start_time FROM flows WHERE protocol = 'TLS' AND sni IS NOT NULL ORDER BY start_time DESC, flow_id LIMIT 50 OFFSET 50")

# -- DNS

_DOM = duck("packets") + f""", q AS (SELECT lower(array_to_string(list_slice(string_split(dns_query, '.'), -2, -1), '.')) AS domain, *,
    array_to_string(list_slice(string_split(lower(dns_query), '.'), 1, len(string_split(dns_query, '.')) - 2), '') AS sub, list_max(list_transform(string_split(dns_query, '.'), lambda v: length(v))) AS longest
    FROM packets WHERE dns_query IS NOT NULL AND dns_query <> ''),
  e AS (SELECT *, round({_entropy('sub')}, 4) AS e FROM q),
  d AS (SELECT domain, count(*) AS queries, round(avg(CASE WHEN e > 0 THEN e END), 4) AS entropy, count(DISTINCT dns_query) AS unique_names, count(DISTINCT src_ip) AS sources,
    count(*) FILTER (dns_type IN ('TXT', 'NULL', 'ANY')) AS txt, count(*) FILTER (longest > 30) AS long, round(avg(longest), 2) AS mean_longest, sum(length(dns_query))::BIGINT AS bytes,
    max(timestamp) - min(timestamp) AS span, arg_min(src_ip, (timestamp, dns_query)) AS src_ip FROM e GROUP BY domain)"""
_add("dns_domain_summary", _on("packets", dns.domain_summary), _DOM + " SELECT * FROM d")
_add(
    "dns_tunnels",
    _on("packets", lambda p: dns.detect_dns_tunnel(p, 5, 1.0)),
    _DOM + """, a AS (
    SELECT 'high_entropy' AS alert_type, *, 50 + (entropy - 4.0e0) * 20 AS s, entropy > 4.5 AS h FROM d WHERE queries >= 5 AND entropy > 4.0
    UNION ALL SELECT 'txt_abuse', *, 40 + txt / queries * 60, txt / queries > 0.5 FROM d WHERE queries >= 5 AND txt / queries > 0.3 AND txt > 10
    UNION ALL SELECT 'long_labels', *, 45 + long * 3, mean_longest > 40 FROM d WHERE queries >= 5 AND long > queries * 0.3e0
    UNION ALL SELECT 'high_frequency', *, 40 + queries / (span / 60) * 0.5e0, queries / (span / 60) > 100 FROM d WHERE queries >= 20 AND span >= 1 AND queries / (span / 60) > 1.0
    UNION ALL SELECT 'unique_subdomains', *, 35 + unique_names / queries * 40, unique_names / queries > 0.95 FROM d WHERE queries >= 20 AND unique_names / queries > 0.8)
    SELECT alert_type, domain, src_ip, queries, round(least(s, 100.0e0), 2) AS score, CASE WHEN h THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM a
    UNION ALL SELECT 'tool_signature', lower(dns_query), min(src_ip), count(*), 95.0, 'HIGH' FROM packets WHERE regexp_matches(lower(dns_query), 't[.]v0|dnscat|dns2tcp|pwn') GROUP BY lower(dns_query)""",
)

# -- encrypted channels

_FIRST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY start_time, flow_id) = 1"
_add("tls_versions", _on("flows", tls.tls_versions), duck("flows") + " SELECT tls_version, count(*) AS flows FROM flows WHERE tls_version IS NOT NULL GROUP BY 1 ORDER BY flows DESC, tls_version LIMIT 10")
_add("deprecated_tls", _on("flows", tls.detect_deprecated_tls), duck("flows") + f" SELECT src_ip, dst_ip, tls_version, flow_id, sni FROM flows WHERE tls_version IN {_in(R.DEPRECATED_TLS)} " + _FIRST.format("src_ip, dst_ip, tls_version"))
_add("tls_without_sni", _on("flows", tls.detect_no_sni), duck("flows") + " SELECT src_ip, count(*) AS flows, count(DISTINCT dst_ip) AS destinations, min(dst_ip) AS dst_ip FROM flows WHERE ja3 IS NOT NULL AND coalesce(sni, '') = '' GROUP BY src_ip HAVING count(*) >= 3")
_add(
    "uniform_tls_sessions",
    _on("flows", lambda f: tls.detect_uniform_sessions(f, 5, 0.6)),
    duck("flows") + """, x AS (SELECT src_ip, dst_ip, count(*) AS flows, count(session_duration) AS k, avg(session_duration) AS m, coalesce(stddev_samp(session_duration), 0) AS s FROM flows WHERE ja3 IS NOT NULL OR protocol = 'TLS' GROUP BY ALL)
    SELECT src_ip, dst_ip, flows, round(m, 2) AS mean_duration, round(s / m, 3) AS cv FROM x WHERE flows > 5 AND k >= 5 AND s / m < 0.6""",
)
_add("unusual_port_tls", _on("flows", tls.detect_unusual_port_tls), duck("flows") + f" SELECT src_ip, dst_ip, dst_port, flow_id FROM flows WHERE protocol = 'TLS' AND dst_port NOT IN {_in(R.TLS_PORTS)} " + _FIRST.format("src_ip, dst_ip, dst_port"))

# -- lateral movement

_INT = duck("flows") + f", i AS (SELECT * FROM flows WHERE {_internal('src_ip')} AND {_internal('dst_ip')})"
_ADM = _in(R.ADMIN_PORTS)
_add(
    "internal_scans",
    _on("flows", lateral.detect_scans),
    _INT + f""", w AS (SELECT src_ip, count(DISTINCT dst_ip) AS targets, min(dst_ip) AS dst_ip FROM i GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 10),
    p AS (SELECT src_ip, dst_port, row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, dst_port) AS r FROM i GROUP BY src_ip, dst_port),
    t AS (SELECT src_ip, count(*) FILTER (dst_port IN {_ADM}) AS admin_ports, max(CASE WHEN r = 1 THEN dst_port END) AS dst_port FROM p WHERE r <= 5 GROUP BY src_ip)
    SELECT src_ip, dst_ip, dst_port, targets, admin_ports, least(100, 30 + targets * 2 + admin_ports * 15) AS score, CASE WHEN targets > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
      CASE WHEN admin_ports > 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM w JOIN t USING (src_ip)""",
)
_add(
    "admin_lateral",
    _on("flows", lateral.detect_admin_lateral),
    _INT + f""", x AS (SELECT i.*, service, technique FROM i JOIN {_ADMIN} USING (dst_port)), b AS (SELECT src_ip FROM x GROUP BY src_ip HAVING count(*) >= 3)
    SELECT src_ip, dst_port, service, technique, count(DISTINCT dst_ip) AS targets, min(dst_ip) AS dst_ip, least(100, 40 + count(DISTINCT dst_ip) * 10) AS score,
      CASE WHEN count(DISTINCT dst_ip) > 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM x WHERE src_ip IN (SELECT src_ip FROM b) GROUP BY ALL HAVING count(DISTINCT dst_ip) >= 2""",
)
_add(
    "credential_relay",
    _on("flows", lateral.detect_cred_relay),
    _INT + f""", a AS (SELECT * FROM i WHERE dst_port IN {_in(R.AUTH_PORTS)})
    SELECT a.src_ip AS origin, a.dst_ip AS relay, b.dst_ip AS target, b.dst_port, a.flow_id AS flow_a, b.flow_id AS flow_b, round(b.start_time - a.start_time, 3) AS delay
    FROM a JOIN a b ON a.dst_ip = b.src_ip AND b.start_time - a.start_time > 0 AND b.start_time - a.start_time < 10 AND b.dst_ip <> a.src_ip""",
)
_add("tool_transfers", _on("flows", lateral.detect_tool_transfer), _INT + " SELECT src_ip, dst_ip, total_bytes, flow_id FROM i WHERE dst_port = 445 AND total_bytes > 5000000 " + _FIRST.format("src_ip, dst_ip"))
_add(
    "pivots",
    _on("flows", lateral.find_pivots),
    _INT + f""", n AS (SELECT dst_ip AS ip, count(DISTINCT src_ip) AS sources FROM flows WHERE NOT {_internal('src_ip')} AND {_internal('dst_ip')} GROUP BY dst_ip),
    o AS (SELECT src_ip AS ip, count(DISTINCT dst_ip) AS targets, count(DISTINCT CASE WHEN dst_port IN {_ADM} THEN dst_port END) AS admin_ports, count(*) AS flows FROM i GROUP BY src_ip)
    SELECT *, least(100, 20 + sources * 10 + targets * 8 + admin_ports * 12) AS risk_score FROM n JOIN o USING (ip) WHERE targets >= 2""",
)
_add("lateral_graph", _on("flows", lateral.lateral_graph), _INT + f" SELECT src_ip, dst_ip, count(*) AS flows, sum(total_bytes)::BIGINT AS bytes, bool_or(dst_port IN {_ADM}) AS admin FROM i GROUP BY ALL ORDER BY flows DESC, bytes DESC, src_ip, dst_ip LIMIT 200")

# -- scalar functions over the distinct names

_add(
    "domain_functions",
    _on("flows", lambda f: f.where("sni is not null").select("sni").distinct().select("sni", S.label_entropy("sni").alias("label_entropy"), S.consonant_ratio("sni").alias("consonants"), S.dga_score("sni").alias("dga"), S.base_domain("sni").alias("base"), S.subdomain_entropy("sni").alias("sub_entropy"), S.mean_label_length("sni").alias("mean_label"), S.longest_label("sni").alias("longest"), S.text_entropy("sni").alias("text_entropy"))),
    duck("flows") + f""", n AS (SELECT DISTINCT sni FROM flows WHERE sni IS NOT NULL), s AS (SELECT *, split_part(sni, '.', 1) AS label, string_split(sni, '.') AS p, CASE WHEN len(string_split(sni, '.')) > 2 THEN array_to_string(list_slice(string_split(lower(sni), '.'), 1, len(string_split(sni, '.')) - 2), '') ELSE '' END AS sub FROM n)
    SELECT sni, round({_entropy('label')}, 4) AS label_entropy, round(length(regexp_replace(lower(label), '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / length(label), 3) AS consonants, {_dga('sni')} AS dga,
      lower(array_to_string(list_slice(p, -2, -1), '.')) AS base, round({_entropy('sub')}, 4) AS sub_entropy, round(list_sum(list_transform(p, lambda v: length(v))) / len(p), 2) AS mean_label,
      list_max(list_transform(p, lambda v: length(v))) AS longest, round({_entropy('lower(sni)')}, 4) AS text_entropy FROM s""",
)
_add(
    "address_functions",
    _on("flows", lambda f: f.select(F.col("dst_ip").alias("ip")).distinct().select("ip", S.ip_to_long("ip").alias("number"), S.is_internal("ip").alias("internal"), S.is_internal("ip", strict=False).alias("internal_loose"), S.prefix24("ip").alias("prefix"))),
    duck("flows") + f" SELECT DISTINCT dst_ip AS ip, split_part(dst_ip, '.', 1)::BIGINT * 16777216 + split_part(dst_ip, '.', 2)::BIGINT * 65536 + split_part(dst_ip, '.', 3)::BIGINT * 256 + split_part(dst_ip, '.', 4)::BIGINT AS number, {_internal('dst_ip')} AS internal, regexp_matches(dst_ip, '^(10[.]|192[.]168[.]|172[.])') AS internal_loose, regexp_extract(dst_ip, '^([0-9]+[.][0-9]+[.][0-9]+)', 1) AS prefix FROM flows",
)

# -- baselines and outliers

_add(
    "baselines",
    _on("flows", hunting.build_baseline),
    duck("flows") + """, m AS (SELECT src_ip, median(total_bytes) AS median_bytes FROM flows GROUP BY src_ip), d AS (SELECT src_ip, median(abs(total_bytes - median_bytes)) AS mad_bytes FROM flows JOIN m USING (src_ip) GROUP BY src_ip),
    p AS (SELECT src_ip, dst_port, row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, dst_port) AS r FROM flows GROUP BY src_ip, dst_port), t AS (SELECT src_ip, string_agg(dst_port::VARCHAR, ',' ORDER BY r) AS top_ports FROM p WHERE r <= 10 GROUP BY src_ip)
    SELECT src_ip, count(*) AS flows, count(DISTINCT dst_ip) AS destinations, median(session_duration) AS median_duration, round(avg((protocol = 'TLS')::INT), 4) AS tls_ratio, any_value(median_bytes) AS median_bytes, any_value(mad_bytes) AS mad_bytes, any_value(top_ports) AS top_ports
    FROM flows JOIN m USING (src_ip) JOIN d USING (src_ip) JOIN t USING (src_ip) GROUP BY src_ip HAVING count(*) >= 5""",
)
_FEAT = duck("flows") + """, pc AS (SELECT src_ip, dst_port, count(*)::DOUBLE AS c FROM flows GROUP BY ALL), pe AS (SELECT src_ip, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS port_entropy FROM pc GROUP BY src_ip),
  x AS (SELECT src_ip, sum(total_bytes)::DOUBLE AS total_bytes, sum(packet_count)::DOUBLE AS packet_count, avg(session_duration) AS session_duration, count(DISTINCT dst_ip)::DOUBLE AS unique_destinations,
    avg((protocol = 'TLS')::INT) AS tls_ratio, any_value(port_entropy) AS port_entropy FROM flows JOIN pe USING (src_ip) GROUP BY src_ip)"""
_Z = {f: f"0.6745e0 * ({f} - {f}_m) / {f}_d" for f in hunting.FEATURES}
_add(
    "outlier_hunt",
    _on("flows", hunting.hunt_outliers),
    _FEAT + ", m AS (SELECT " + ", ".join(f"median({f}) AS {f}_m" for f in hunting.FEATURES) + " FROM x), d AS (SELECT " + ", ".join(f"greatest(median(abs({f} - {f}_m)), 0.001e0) AS {f}_d" for f in hunting.FEATURES)
    + " FROM x, m), s AS (SELECT *, sqrt((" + " + ".join(f"power({z}, 2)" for z in _Z.values()) + ") / 6) AS s FROM x, m, d) SELECT src_ip, round(s, 2) AS score, array_to_string(list_filter([" + ", ".join(f"CASE WHEN abs({z}) > 2.5 THEN '{f}' END" for f, z in _Z.items())
    + "], lambda v: v IS NOT NULL), ',') AS features, CASE WHEN s > 6 THEN 'CRITICAL' WHEN s > 4.5 THEN 'HIGH' WHEN s > 3.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s WHERE s > 3.0",
)
_add(
    "peer_outliers",
    _on("flows", hunting.peer_outliers),
    duck("flows") + """, x AS (SELECT src_ip, regexp_extract(src_ip, '^([0-9]+[.][0-9]+[.][0-9]+)', 1) AS subnet, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY src_ip), m AS (SELECT subnet, median(bytes) AS md, count(*) AS peers FROM x GROUP BY subnet),
    d AS (SELECT subnet, median(abs(bytes - md)) AS mad FROM x JOIN m USING (subnet) GROUP BY subnet), z AS (SELECT src_ip, subnet, peers, bytes, round(0.6745e0 * (bytes - md) / mad, 3) AS z FROM x JOIN m USING (subnet) JOIN d USING (subnet) WHERE peers >= 3 AND mad > 0)
    SELECT * FROM z WHERE abs(z) > 3""",
)
_add(
    "temporal_hunt",
    _on("flows", hunting.hunt_temporal),
    duck("flows") + """, n AS (SELECT src_ip, (floor(start_time / 3600)::BIGINT % 24)::INT AS hour, count(*) AS c FROM flows GROUP BY ALL),
    x AS (SELECT src_ip, sum(c)::BIGINT AS flows, sum(CASE WHEN hour <= 5 THEN c ELSE 0 END) AS off, max(c) AS top, arg_max(hour, (c, -hour)) AS top_hour FROM n GROUP BY src_ip)
    SELECT src_ip, flows, round(off / flows, 4) AS off_ratio, top_hour, round(top / flows, 4) AS top_ratio FROM x WHERE flows >= 10 AND (round(off / flows, 4) > 0.4 OR round(top / flows, 4) > 0.5)""",
)

# -- relays

_NODES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in R.RELAY_NODES.items()) + ") n(ip, node_type)"
_REL = duck("flows") + f", m AS (SELECT f.*, coalesce(a.ip, b.ip) AS relay_ip, coalesce(a.node_type, b.node_type) AS node_type FROM flows f LEFT JOIN {_NODES.replace(') n(', ') a(')} ON a.ip = dst_ip LEFT JOIN {_NODES.replace(') n(', ') b(')} ON b.ip = src_ip WHERE a.ip IS NOT NULL OR b.ip IS NOT NULL)"
_add("relay_flows", _on("flows", relay.match_relay_nodes), _REL + " SELECT flow_id, src_ip, dst_ip, relay_ip, node_type FROM m")
_add(
    "relay_cells",
    _on("packets", relay.cell_ratios),
    duck("packets") + " SELECT src_ip, dst_ip, count(*) AS packets, round(avg((abs(size - 541) <= 30 OR abs(size - 1082) <= 60 OR abs(size - 1623) <= 90)::INT), 4) AS cell_ratio FROM packets GROUP BY ALL HAVING count(*) >= 20 AND round(avg((abs(size - 541) <= 30 OR abs(size - 1082) <= 60 OR abs(size - 1623) <= 90)::INT), 4) > 0.55",
)
_add(
    "relay_persistence",
    _on("flows", relay.relay_persistence),
    _REL + ", u AS (SELECT src_ip, relay_ip, count(*) AS uses FROM m GROUP BY ALL) SELECT src_ip, relay_ip, uses, count(*) OVER (PARTITION BY src_ip) AS relays, round(uses / sum(uses) OVER (PARTITION BY src_ip), 4) AS share FROM u",
)

_add(
    "relay_c2",
    _on("flows", lambda f: relay.relay_c2(f, least=3, least_gaps=2, max_cv=0.9, max_gap=1e9)),
    _REL + """, g AS (SELECT src_ip, relay_ip, start_time - lag(start_time) OVER (PARTITION BY src_ip, relay_ip ORDER BY start_time, flow_id) AS gap FROM m),
    s AS (SELECT src_ip, relay_ip, avg(gap) AS mg, stddev_samp(gap) AS sd FROM g WHERE gap > 0 AND gap < 1e9 GROUP BY src_ip, relay_ip HAVING count(*) >= 2 AND avg(gap) > 10),
    n AS (SELECT src_ip, relay_ip, count(*) AS flows FROM m GROUP BY src_ip, relay_ip HAVING count(*) >= 3)
    SELECT src_ip, relay_ip, flows, round(sd / mg, 4) AS cv FROM n JOIN s USING (src_ip, relay_ip) WHERE round(sd / mg, 4) < 0.9""",
)


def _deviations(flows):
    """The other sessions' flows against a baseline of four sessions."""
    usual = F.col("session_id").isin("s0", "s1", "s2", "s3")
    return hunting.detect_deviations(flows.where(~usual), flows.where(usual))


_add(
    "baseline_deviations",
    _on("flows", _deviations),
    duck("flows") + """, h AS (SELECT *, (floor(start_time / 3600)::BIGINT % 24)::INT AS hour, session_id IN ('s0', 's1', 's2', 's3') AS past FROM flows), u AS (SELECT * FROM h WHERE past), c AS (SELECT * FROM h WHERE NOT past),
    m AS (SELECT src_ip, median(total_bytes) AS mb FROM u GROUP BY src_ip HAVING count(*) >= 5), d AS (SELECT src_ip, median(abs(total_bytes - mb)) AS mad FROM u JOIN m USING (src_ip) GROUP BY src_ip),
    n AS (SELECT src_ip, count(*) AS nf, sum(total_bytes)::BIGINT AS nb FROM c GROUP BY src_ip), z AS (SELECT *, abs(CASE WHEN mad = 0 THEN 0.0 ELSE round(0.6745e0 * (nb - mb) / mad, 3) END) AS z FROM n JOIN m USING (src_ip) JOIN d USING (src_ip)),
    lv AS (SELECT src_ip, past, unnest([struct_pack(kind := 'new_destinations', v := dst_ip), struct_pack(kind := 'unusual_hours', v := hour::VARCHAR), struct_pack(kind := 'new_ports', v := dst_port::VARCHAR)], recursive := true) FROM h),
    lc AS (SELECT src_ip, kind, v, count(*) FILTER (past) AS before, count(*) FILTER (NOT past) AS after FROM lv WHERE src_ip IN (SELECT src_ip FROM m) GROUP BY ALL),
    lr AS (SELECT *, row_number() OVER (PARTITION BY src_ip, kind ORDER BY before DESC, CASE WHEN kind = 'new_destinations' THEN 0 ELSE v::INT END, v) AS r FROM (SELECT * FROM lc WHERE before > 0)),
    lk AS (SELECT src_ip, kind, v FROM lr WHERE r <= CASE kind WHEN 'unusual_hours' THEN 8 ELSE 10 END),
    ln AS (SELECT src_ip, kind, count(*) AS new FROM lc ANTI JOIN lk USING (src_ip, kind, v) WHERE after > 0 GROUP BY ALL), ls AS (SELECT src_ip, kind, count(*) AS known FROM lk GROUP BY ALL)
    SELECT src_ip, 'new_endpoint' AS kind, nf::DOUBLE AS value, 0.0e0 AS usual, 40.0e0 AS risk, 'MEDIUM' AS severity FROM n WHERE src_ip NOT IN (SELECT src_ip FROM m) AND nf > 20
    UNION ALL SELECT src_ip, 'byte_spike', nb::DOUBLE, mb, round(least(100.0e0, 35 + z * 8), 2), CASE WHEN z > 5 THEN 'HIGH' ELSE 'MEDIUM' END FROM z WHERE z > 3
    UNION ALL SELECT src_ip, kind, new::DOUBLE, known::DOUBLE, CASE kind WHEN 'new_destinations' THEN least(80, 30 + 3 * new) WHEN 'unusual_hours' THEN least(60, 25 + 8 * new) ELSE least(50, 20 + 4 * new) END::DOUBLE, 'MEDIUM'
      FROM ln JOIN ls USING (src_ip, kind) WHERE CASE kind WHEN 'new_destinations' THEN new > 5 AND new > 0.5 * known WHEN 'unusual_hours' THEN true ELSE new > 3 END""",
)

# -- graph

_EDG = duck("flows") + ", e AS (SELECT src_ip AS src, dst_ip AS dst, sum(total_bytes)::BIGINT AS weight, count(*) AS flows FROM flows WHERE src_ip <> dst_ip GROUP BY ALL)"
_DEG = _EDG + """, dg AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(ow)::BIGINT AS out_weight, sum(iw)::BIGINT AS in_weight, sum(o + i)::BIGINT AS degree
  FROM (SELECT src AS node, 1 AS o, 0 AS i, weight AS ow, 0 AS iw FROM e UNION ALL SELECT dst, 0, 1, 0, weight FROM e) GROUP BY node)"""
_add("graph_degrees", _on("flows", lambda f: graph.degrees(graph.build_edges(f))), _DEG + " SELECT * FROM dg")
_add(
    "graph_clustering",
    _on("flows", lambda f: graph.clustering(graph.build_edges(f))),
    _EDG + """, k AS (SELECT src, count(*) AS k FROM e GROUP BY src), c AS (SELECT a.src, count(*) AS c FROM e a JOIN e b ON a.src = b.src AND a.dst <> b.dst JOIN e x ON x.src = a.dst AND x.dst = b.dst GROUP BY a.src)
    SELECT src AS node, k, CASE WHEN k > 1 THEN round(coalesce(c, 0) / (k * (k - 1)), 4) ELSE 0.0 END AS clustering FROM k LEFT JOIN c USING (src)""",
)
_add(
    "graph_anomalies",
    _on("flows", lambda f: graph.structural_anomalies(graph.build_edges(f), 2.0, 5_000_000, 1_000_000, 5.0)),
    _DEG + """, s AS (SELECT avg(degree) AS m, stddev_samp(degree) AS sd FROM dg)
    SELECT 'hub_node' AS kind, node, NULL AS peer, degree::DOUBLE AS value FROM dg, s WHERE (degree - m) / sd > 2
    UNION ALL SELECT 'asymmetric_traffic', node, NULL, round(out_weight / in_weight, 2) FROM dg WHERE out_weight > 1000000 AND in_weight > 0 AND out_weight / in_weight > 5
    UNION ALL SELECT 'isolated_heavy_edge', src, dst, weight::DOUBLE FROM e WHERE weight > 5000000 AND src IN (SELECT node FROM dg WHERE degree <= 3)""",
)
_PR = _EDG + ", k AS (SELECT src, count(*) AS k FROM e GROUP BY src), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT node, 1.0e0 / n AS rank FROM v, n)"
for _i in range(1, 6):
    _PR += f", r{_i} AS (SELECT v.node, 0.15e0 / any_value(n) + 0.85e0 * coalesce(sum(rank / k), 0) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT dst, rank, k FROM e JOIN k USING (src) JOIN r{_i - 1} ON node = src) g ON g.dst = v.node GROUP BY v.node)"
_add("page_rank", _on("flows", lambda f: graph.page_rank(graph.build_edges(f), rounds=5).withColumn("rank", F.round("rank", 9))), _PR + " SELECT node, round(rank, 9) AS rank FROM r5")
_add("communities", _on("flows", lambda f: graph.label_propagation(graph.build_edges(f), 5)))

# -- models

_add("ja3_rarity", _on("flows", models.ja3_rarity), duck("flows") + " SELECT ja3, count(*) AS flows, round(1 - count(*) / sum(count(*)) OVER (), 4) AS rarity FROM flows WHERE ja3 IS NOT NULL GROUP BY ja3")
_add(
    "min_max_features",
    _on("flows", lambda f: models.min_max(hunting.source_features(f).select("src_ip", "total_bytes", "packet_count", "unique_destinations"), ["total_bytes", "packet_count", "unique_destinations"])[0].select("src_ip", *[F.round(c, 6).alias(c) for c in ("total_bytes", "packet_count", "unique_destinations")])),
    _FEAT + " SELECT src_ip, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in ("total_bytes", "packet_count", "unique_destinations")) + " FROM x",
)
_add(
    "stratified_split",
    _on("flows", lambda f: models.stratified_split(f.select("flow_id", "protocol"), "protocol", "flow_id")),
    duck("flows") + ", p AS (SELECT flow_id, protocol, percent_rank() OVER (PARTITION BY protocol ORDER BY md5(concat('42:', flow_id)), flow_id) AS r FROM flows) SELECT flow_id, protocol, CASE WHEN r < 0.70 THEN 0 WHEN r < 0.85 THEN 1 ELSE 2 END AS part FROM p",
)
_add("flow_anomalies", _on("flows", lambda f: models.flow_anomalies(f, cut=0.5)))

# -- alerts

_AL = duck("alerts") + ", al AS (SELECT *, round(100 * price / max(price) OVER (), 4) AS threat_score FROM alerts)"


def _alerts(f):
    def run(a):
        top = a.agg(F.max("price").alias("top"))
        return f(a.crossJoin(F.broadcast(top)).withColumn("threat_score", F.round(100 * F.col("price") / F.col("top"), 4)).drop("top"))

    return _on("alerts", run)


_AS_OF = 1704067200.0
_SLA = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 24 ELSE 72 END"
_add("alert_dashboard", _alerts(soc.dashboard), _AL + " SELECT tenant_id, severity, status, count(*) AS alerts, round(avg(threat_score), 4) AS mean_score FROM al GROUP BY ALL")
_add("alerts_hourly", _alerts(soc.hourly), _AL + " SELECT (floor(created / 3600) * 3600)::BIGINT AS hour, count(*) AS alerts, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high FROM al GROUP BY 1")
_add(
    "active_alerts",
    _alerts(lambda a: soc.active_alerts(a).select("alert_id", "severity", "threat_score")),
    _AL + " SELECT alert_id, severity, threat_score FROM al WHERE status IN ('new', 'triaged') ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, threat_score DESC, alert_id LIMIT 100",
)
_add(
    "alert_deduplication",
    _alerts(soc.deduplicate),
    _AL + " SELECT arg_min(alert_id, (created, alert_id)) AS alert_id, src_ip, dst_ip, category, session_id, max(threat_score) AS max_score, count(*) AS n_alerts FROM al GROUP BY src_ip, dst_ip, category, session_id",
)
_add(
    "soc_metrics",
    _alerts(lambda a: soc.metrics(a, _AS_OF)),
    _AL + f""" SELECT tenant_id, count(*) AS total, count(*) FILTER (status <> 'resolved') AS open, count(*) FILTER (severity = 'CRITICAL') AS critical, round(avg(CASE WHEN status = 'resolved' THEN (resolved - created) / 3600 END), 4) AS mttr_hours,
    round(avg((NOT (CASE WHEN status = 'resolved' THEN resolved ELSE {_AS_OF} END > created + {_SLA} * 3600.0e0))::INT), 4) AS sla_rate FROM al GROUP BY tenant_id""",
)
_add("analyst_workload", _alerts(soc.workload), _AL + " SELECT assignee, count(*) AS open_alerts, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS urgent FROM al WHERE status <> 'resolved' GROUP BY assignee")
_add(
    "unified_threats",
    _alerts(soc.unified_threats),
    _AL + """, u AS (SELECT src_ip AS ip, * FROM al UNION ALL SELECT dst_ip, * FROM al WHERE src_ip <> dst_ip),
    g AS (SELECT ip, count(*) AS n_alerts, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, round(least(100.0, max(threat_score) + least(20, 8 * (count(DISTINCT category) - 1))), 4) AS score FROM u GROUP BY ip HAVING count(*) >= 2)
    SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity, substr(md5(concat('threat:', ip)), 1, 12) AS threat_id FROM g""",
)
_add(
    "cef_export",
    _alerts(lambda a: soc.export(a.withColumn("title", F.concat(F.lit("Alert | "), "category")).withColumn("threat_score", F.floor("threat_score")), "cef", severity="critical")),
    _AL + f""" SELECT alert_id, concat('CEF:0|{soc.VENDOR}|{soc.PRODUCT}|{soc.VERSION}|', category, '|', 'Alert \\| ', category, '|10|src=', src_ip, ' dst=', dst_ip, ' act=', status, ' cs1=', alert_id, ' cs1Label=AlertID cfp1=', floor(threat_score)::BIGINT, ' cfp1Label=ThreatScore') AS line FROM al WHERE severity = 'CRITICAL'""",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
