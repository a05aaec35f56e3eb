"""Queries of the reads that put finished tables together, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import circuits, correlation, graph, overview, traffic
from netloom.operators import infrastructure as infra
from netloom.operators import reference as R
from netloom.operators.scans import stored
from netloom.plans import catalog, catalog_scans, catalog_threats, fixtures
from netloom.plans.catalog import _EDG, _MALWARE, _alerts, _on
from netloom.plans.catalog_threats import _DA, _ON_FLOWS, _over
from netloom.plans.fixtures import duck

_Q: dict = {}
_SQL: dict = {}
_S = catalog.oracle_sql() | catalog_threats.oracle_sql() | catalog_scans.oracle_sql()


def _add(name: str, run, sql: str | None = None) -> None:
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _audit(spark, sf_dir):
    e = _table("events")(spark, sf_dir)
    return e.select(F.col("event_id").alias("audit_id"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("u"), "user_id").alias("user_id"), F.col("event_type").alias("action"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


_add(
    "audit_query",
    lambda spark, sf_dir: overview.audit_query(_audit(spark, sf_dir), "t1", action="error", since=1_704_500_000.0),
    """SELECT event_id AS audit_id, concat('t', user_id % 3) AS tenant_id, concat('u', user_id) AS user_id, event_type AS action, epoch_us(ts) / 1000000.0e0 AS "at" FROM events WHERE user_id % 3 = 1 AND event_type = 'error' AND epoch_us(ts) / 1000000.0e0 >= 1704500000 ORDER BY "at" DESC, audit_id DESC LIMIT 100""",
)
_add("top_talkers_bytes", _on("flows", overview.talkers), duck("flows") + " SELECT dst_ip AS ip, sum(total_bytes)::BIGINT AS bytes, count(*) AS flows FROM flows GROUP BY dst_ip ORDER BY bytes DESC, ip LIMIT 10")
_add("top_talkers_flows", _on("flows", lambda f: overview.talkers(f, "src_ip", "flows")), duck("flows") + " SELECT src_ip AS ip, sum(total_bytes)::BIGINT AS bytes, count(*) AS flows FROM flows GROUP BY src_ip ORDER BY flows DESC, ip LIMIT 10")


# -- geography: a nation has a /24 block of either of two nets


def _blocks(spark, sf_dir):
    n = _table("nation")(spark, sf_dir)
    start = F.explode(F.array(F.lit(203 * 2**24) + F.col("n_nationkey") * 256, F.lit(198 * 2**24 + 51 * 65536) + F.col("n_nationkey") * 256)).alias("start_ip")
    return n.select("n_name", "n_nationkey", start).select("start_ip", (F.col("start_ip") + 255).alias("end_ip"), F.col("n_nationkey").alias("block_order"), F.col("n_name").alias("country"))


_BLOCKS = "bl AS (SELECT unnest([203 * 16777216::BIGINT + n_nationkey * 256, 198 * 16777216::BIGINT + 51 * 65536 + n_nationkey * 256]) AS s, n_name AS country FROM nation)"
_NUMBER = "(split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT)"
_PUBLIC = "NOT regexp_matches(ip, '^(10[.]|127[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])')"
_add(
    "geo_distribution",
    lambda spark, sf_dir: overview.geo_distribution(fixtures.flows(spark, sf_dir), _blocks(spark, sf_dir)),
    duck("flows") + f", {_BLOCKS}, e AS (SELECT unnest([src_ip, dst_ip]) AS ip FROM flows) SELECT coalesce(country, '??') AS country, count(*) AS connections, count(DISTINCT ip) AS addresses FROM e LEFT JOIN bl ON {_NUMBER} BETWEEN s AND s + 255 WHERE {_PUBLIC} GROUP BY 1",
)
_add(
    "infrastructure_overview",
    lambda spark, sf_dir: overview.infrastructure_overview(infra.infrastructure_nodes(catalog_scans._threats(spark, sf_dir)), _blocks(spark, sf_dir)),
    f"WITH {_BLOCKS}, x AS ({_S['infrastructure_nodes']}) SELECT node_type, coalesce(country, '??') AS country, count(*) AS nodes, round(sum(confidence), 3) AS total_confidence, max(confidence) AS top_confidence, max(last_seen) AS last_seen FROM x LEFT JOIN bl ON {_NUMBER} BETWEEN s AND s + 255 GROUP BY ALL",
)

# -- relays, timeline, techniques, groups, posture


def _events(spark, sf_dir):
    return circuits.relay_events(fixtures.flows(spark, sf_dir), fixtures.packets(spark, sf_dir))


_level = lambda s, low, high: f"count(*) FILTER (score >= {low} AND score < {high}) AS {s}"
_add(
    "relay_counters",
    lambda spark, sf_dir: overview.relay_counters(_events(spark, sf_dir)),
    f"SELECT sum(findings)::BIGINT AS events, " + ", ".join(f"coalesce(sum(findings) FILTER (kind = '{k}'), 0)::BIGINT AS {k}" for k in ("relay_flow", "cell_sizes", "relay_c2", "relay_traffic")) + f", count(DISTINCT src_ip) AS sources, {_level('critical', 80, 1e9)}, {_level('high', 65, 80)}, {_level('medium', 50, 65)}, {_level('low', -1e9, 50)} FROM ({_S['relay_events']})",
)


def _timeline(spark, sf_dir):
    # derived and written once for all detectors
    flows = stored(fixtures.flows(spark, sf_dir).select("flow_id", "src_ip", "dst_ip", "start_time", "total_bytes", "sni"))
    packets = stored(fixtures.packets(spark, sf_dir).select("packet_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size"))
    first = flows.groupBy("src_ip", "dst_ip").agg(F.min("start_time").alias("at"))
    began = stored(traffic.aggregate_flows(packets).select("flow_id", "src_ip", "dst_ip", "dst_port", F.col("start_time").alias("at")))
    found = {
        "dga": _ON_FLOWS["dga_domains"](flows).select("flow_id", F.col("src_ip").alias("ip"), F.col("sni").alias("detail")),
        "relay": _ON_FLOWS["relay_flows"](flows).select("flow_id", F.col("src_ip").alias("ip"), F.col("node_type").alias("detail")),
    }
    # both in one, so flows are dealt once for their times
    named = stored(reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(k)) for k, df in found.items()]))
    named = named.join(flows.select("flow_id", F.col("start_time").alias("at")), "flow_id")
    out = overview.anomaly_timeline({
        "beacon": traffic.detect_beacons(packets, began).join(began.select("flow_id", "at"), "flow_id").select("at", F.col("src_ip").alias("ip"), F.col("beacon_type").alias("detail")),
        "exfiltration": _ON_FLOWS["exfiltration"](flows).join(first, ["src_ip", "dst_ip"]).select("at", F.col("src_ip").alias("ip"), F.col("dst_ip").alias("detail")),
    })
    return out.unionByName(named.select("kind", "at", "ip", "detail"))


_FL = f"fl AS ({duck('flows')} SELECT * FROM flows)"
_add(
    "anomaly_timeline",
    _timeline,
    f"""WITH {_FL}, ag AS ({_S['flow_aggregation']}), fi AS (SELECT src_ip, dst_ip, min(start_time) AS t0 FROM fl GROUP BY ALL)
    SELECT 'beacon' AS kind, ag.start_time AS "at", b.src_ip AS ip, beacon_type AS detail FROM ({_S['beacons']}) b JOIN ag USING (flow_id)
    UNION ALL SELECT 'exfiltration', t0, x.src_ip, x.dst_ip FROM ({_S['exfiltration']}) x JOIN fi USING (src_ip, dst_ip)
    UNION ALL SELECT 'dga', fl.start_time, d.src_ip, d.sni FROM ({_S['dga_domains']}) d JOIN fl USING (flow_id)
    UNION ALL SELECT 'relay', fl.start_time, r.src_ip, r.node_type FROM ({_S['relay_flows']}) r JOIN fl USING (flow_id)""",
)
_add("technique_lookup", _over(lambda a: overview.technique_lookup(correlation.technique_map(a), "T1071")), f"SELECT * FROM ({_S['technique_map']}) WHERE technique = 'T1071' OR technique LIKE 'T1071.%'")
_add(
    "threat_groups",
    _over(overview.threat_groups),
    _DA + """, nm AS (SELECT DISTINCT engine, category, unnest([src_ip, dst_ip]) AS ip FROM da), nn AS (SELECT engine, category, count(*) AS indicators, array_to_string(list(ip ORDER BY ip)[:10], ',') AS names FROM nm WHERE ip IS NOT NULL GROUP BY ALL)
    SELECT engine, category, count(*) AS alerts, count(DISTINCT src_ip) AS sources, max(score) AS score, any_value(indicators) AS indicators, any_value(names) AS "some" FROM da JOIN nn USING (engine, category) GROUP BY ALL""",
)
_add(
    "posture",
    _on("alerts", overview.posture),
    duck("alerts") + """, x AS (SELECT count(*) AS alerts, count(*) FILTER (status <> 'resolved') AS open, count(*) FILTER (status <> 'resolved' AND severity IN ('CRITICAL', 'HIGH')) AS urgent_open, count(*) FILTER (status = 'resolved') AS resolved,
      count(DISTINCT assignee) AS users, count(DISTINCT tenant_id) AS tenants, round(avg(CASE WHEN status = 'resolved' THEN (resolved - created) / 3600 END), 4) AS mean_hours FROM alerts)
    SELECT *, round(resolved / alerts, 4) AS resolved_share, CASE WHEN resolved / alerts >= 0.9 THEN 'good' WHEN resolved / alerts >= 0.5 THEN 'fair' ELSE 'poor' END AS state FROM x""",
)
_add(
    "graph_summary",
    _on("flows", lambda f: overview.graph_summary(graph.build_edges(f), z=2.0, heavy=5_000_000, sent=1_000_000, ratio=5.0)),
    f"""WITH e AS ({_EDG} SELECT * FROM e), dg AS ({_S['graph_degrees']}) SELECT count(*) AS nodes, max(degree)::BIGINT AS top_degree, round(avg(degree), 4) AS mean_degree, (SELECT count(*) FROM e) AS edges, (SELECT sum(weight)::BIGINT FROM e) AS bytes,
    (SELECT sum(flows)::BIGINT FROM e) AS flows, (SELECT count(*) FROM ({_S['graph_anomalies']})) AS anomalies, round((SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 6) AS density FROM dg""",
)
_add(
    "analysis_summary",
    lambda spark, sf_dir: overview.analysis_summary(fixtures.packets(spark, sf_dir), fixtures.flows(spark, sf_dir), min_sent=1e6),
    f"""WITH {_FL}, pk AS ({duck('packets')} SELECT * FROM packets) SELECT 'total_flows' AS name, count(*) AS n FROM fl UNION ALL SELECT 'total_packets', count(*) FROM pk UNION ALL SELECT 'beacons', count(*) FROM ({_S['beacons']}) WHERE confidence <> 'LOW'
    UNION ALL SELECT 'bursts', count(*) FROM ({_S['bursts']}) UNION ALL SELECT 'exfil_alerts', count(*) FROM ({_S['exfiltration']}) UNION ALL SELECT 'ttl_anomalies', count(*) FROM ({_S['ttl_anomalies']})
    UNION ALL SELECT 'dga_domains', count(*) FROM ({_S['dga_domains']}) UNION ALL SELECT 'tls_flows', count(*) FROM fl WHERE protocol = 'TLS'""",
)
_add("feature_rows", lambda spark, sf_dir: overview.feature_rows(catalog.queries()["min_max_features"](spark, sf_dir), "src_ip"), f"UNPIVOT ({_S['min_max_features']}) ON total_bytes, packet_count, unique_destinations INTO NAME feature VALUE value")
_add("anomalous_scores", lambda spark, sf_dir: overview.anomalous_scores(catalog.queries()["flow_anomalies"](spark, sf_dir), 0.55))

# -- arrays, bytes, browser events, live counters

_add(
    "protocol_counts",
    _on("flows", lambda f: f.groupBy("src_ip").agg(F.collect_list("protocol").alias("p")).select("src_ip", F.array_join(F.transform(F.map_entries(overview.count_map("p")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))),
    duck("flows") + ", c AS (SELECT src_ip, protocol, count(*) AS n FROM flows GROUP BY ALL) SELECT src_ip, string_agg(concat(protocol, ':', n), ',' ORDER BY protocol) AS counts FROM c GROUP BY src_ip",
)
_add(
    "payload_entropy",
    lambda spark, sf_dir: _table("pages")(spark, sf_dir).select("page_id", overview.byte_entropy(F.col("html").cast("binary")).alias("entropy")),
    """WITH h AS (SELECT page_id, substr(hex(encode(coalesce(html, ''))), 1, 512) AS h FROM pages), b AS (SELECT page_id, substr(h, 2 * i - 1, 2) AS b, length(h) / 2 AS n FROM h, unnest(range(1, length(h) // 2 + 1)) t(i)),
    c AS (SELECT page_id, any_value(n) AS n, count(*)::DOUBLE AS c FROM b GROUP BY page_id, b), e AS (SELECT page_id, round(log2(any_value(n)) - sum(c * log2(c)) / any_value(n), 4) AS e FROM c GROUP BY page_id)
    SELECT page_id, coalesce(e, 0.0) AS entropy FROM h LEFT JOIN e USING (page_id)""",
)


def _browsed(spark, sf_dir):
    pages = _table("pages")(spark, sf_dir).select("page_id", F.lower(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)).alias("domain"))
    bad = pages.where("page_id % 7 = 0").select(F.substring_index("domain", ".", -2).alias("value")).distinct()
    return overview.flag_domains(pages, bad).select("page_id", "domain", "matched")


_add(
    "flagged_domains",
    _browsed,
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS domain FROM pages), v AS (SELECT DISTINCT array_to_string(string_split(domain, '.')[-2:], '.') AS value FROM p WHERE page_id % 7 = 0),
    s AS (SELECT domain, string_split(domain, '.') AS w FROM (SELECT DISTINCT domain FROM p)), x AS (SELECT domain, i, array_to_string(w[i:], '.') AS suffix FROM s, unnest(range(1, greatest(len(w), 2))) t(i)),
    h AS (SELECT domain, arg_min(suffix, i) AS matched FROM x JOIN v ON value = suffix GROUP BY domain) SELECT page_id, domain, matched FROM p JOIN h USING (domain)""",
)


def _live(flows):
    x = flows.select(F.timestamp_seconds("start_time").alias("ts"), "protocol", "sni", "ja3")
    return overview.live_counters(x, R.malware_ja3(flows.sparkSession), "7 days")


_add(
    "live_counters",
    _on("flows", _live),
    duck("flows") + f" SELECT floor(start_time / 604800) * 604800.0::DOUBLE AS start, protocol, count(*) AS packets, count(*) FILTER (sni <> '') AS with_sni, count(malware) AS malware FROM flows LEFT JOIN {_MALWARE} USING (ja3) GROUP BY ALL",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
