"""Queries of ordered scans and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import sql as functions
from netloom.operators import circuits, correlation, hunting, infrastructure, lateral, registry, relay, stepping, stix_store, tls
from netloom.operators import reference as R
from netloom.operators.scans import shared_folder
from netloom.plans import catalog, fixtures
from netloom.sources import storage
from netloom.plans.catalog import _AL, _alerts, _internal, _on
from netloom.plans.catalog_threats import _GUARDS
from netloom.plans.fixtures import duck
from netloom.streaming.incremental import Incremental

_Q: dict = {}
_SQL: dict = {}


def _add(name: str, run, sql: str | None = None) -> None:
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


# -- stepping stones: packets in bursts and packets at steady times


def _stones(p):
    p = p.withColumn("pair", F.concat_ws(">", "src_ip", "dst_ip"))
    return stepping.correlate_timing(p.where("src_port % 10 = 1"), p.where("src_port % 10 = 0"), "pair", "pair", lo=0.05, hi=120.0, cut=0.2)


_add(
    "timing_correlations",
    _on("packets", _stones),
    duck("packets") + """, s AS (SELECT concat(src_ip, '>', dst_ip) AS k, src_port % 10 AS g, list(timestamp ORDER BY timestamp) AS ts FROM packets WHERE src_port % 10 < 2 GROUP BY ALL HAVING count(*) >= 10),
    p AS (SELECT a.k AS in_key, b.k AS out_key, a.ts AS a, b.ts AS b, least(a.ts[-1], b.ts[-1]) - greatest(a.ts[1], b.ts[1]) AS time_window FROM s a, s b WHERE a.g = 1 AND b.g = 0),
    m AS (SELECT *, list_reduce(list_prepend({'t': 0.0::DOUBLE, 'i': 0::BIGINT, 'd': []::DOUBLE[]}, list_transform(a, lambda t: {'t': t, 'i': 0::BIGINT, 'd': []::DOUBLE[]})),
      lambda acc, e: CASE WHEN b[greatest(acc.i, len(list_filter(b, lambda x: x < e.t + 0.05))) + 1] <= e.t + 120.0
        THEN {'t': e.t, 'i': greatest(acc.i, len(list_filter(b, lambda x: x < e.t + 0.05))) + 1, 'd': list_append(acc.d, b[greatest(acc.i, len(list_filter(b, lambda x: x < e.t + 0.05))) + 1] - e.t)}
        ELSE {'t': e.t, 'i': greatest(acc.i, len(list_filter(b, lambda x: x < e.t + 0.05))), 'd': acc.d} END).d AS d FROM p WHERE time_window > 0),
    g AS (SELECT k, g, list(gap ORDER BY n) AS gaps FROM (SELECT k, g, i AS n, ts[i + 1] - ts[i] AS gap FROM s, unnest(range(1, len(ts))) t(i)) WHERE gap > 0 GROUP BY ALL),
    r AS (SELECT m.*, (SELECT CASE WHEN count(*) < 5 OR isnan(corr(x.gaps[i], y.gaps[i])) THEN 0.0 ELSE coalesce(round(corr(x.gaps[i], y.gaps[i]), 4), 0.0) END FROM unnest(range(1, least(len(x.gaps), len(y.gaps)) + 1)) t(i)) AS c
      FROM m JOIN g x ON x.k = in_key AND x.g = 1 JOIN g y ON y.k = out_key AND y.g = 0 WHERE len(d) >= 10),
    f AS (SELECT *, list_aggregate(d, 'avg') AS m, list_aggregate(d, 'stddev_samp') AS v, 0.3 * least(1.0, len(d) / (len(a) * 0.5)) + 0.3 * greatest(0.0, 1 - CASE WHEN list_aggregate(d, 'avg') > 0 THEN list_aggregate(d, 'stddev_samp') / list_aggregate(d, 'avg') ELSE 1.0 END) + 0.4 * greatest(0.0, c) AS q FROM r)
    SELECT in_key, out_key, len(d) AS samples, round(m, 4) AS delay_mean, round(v, 4) AS delay_deviation, c AS gap_correlation, round(q, 4) AS score,
      CASE WHEN q > 0.8 THEN 'CRITICAL' WHEN q > 0.6 THEN 'HIGH' WHEN q > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round(time_window, 3) AS time_window FROM f WHERE q >= 0.2""",
)


# -- circuits that use up their flows


def _circuits(spark, sf_dir):
    return circuits.relay_circuits(fixtures.flows(spark, sf_dir), fixtures.packets(spark, sf_dir), max_gap=30_000.0)


_ORDER = "(PARTITION BY src_ip ORDER BY start_time, flow_id)"
_add(
    "relay_circuits",
    _circuits,
    duck("flows", "packets") + f""", x AS (SELECT *, row_number() OVER {_ORDER} AS i FROM flows WHERE {_internal('src_ip')} AND (dst_ip IN {_GUARDS.replace(')', ", '185.220.101.47')")} OR dst_port IN (9001, 9030, 9040, 9050, 9051, 9150, 443, 80))),
    l AS (SELECT src_ip, i, flow_id, start_time, dst_ip, list({{'i': i, 't': start_time, 'd': dst_ip}}) OVER (PARTITION BY src_ip ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS ahead FROM x),
    c AS (SELECT src_ip, i, list_reduce(list_prepend({{'c': [ahead[1]], 'over': false}}, list_transform(ahead[2:], lambda e: {{'c': [e], 'over': false}})),
      lambda a, e: CASE WHEN a.over OR e.c[1].t - a.c[-1].t >= 30000 THEN {{'c': a.c, 'over': true}}
        WHEN e.c[1].t - a.c[-1].t > 0.01 AND len(list_filter(a.c, lambda h: h.d = e.c[1].d)) = 0 THEN {{'c': list_concat(a.c, e.c), 'over': false}} ELSE a END).c AS c FROM l),
    w AS (SELECT src_ip, list(CASE WHEN len(c) >= 3 THEN len(c) ELSE 1 END ORDER BY i) AS jumps FROM c GROUP BY src_ip),
    v AS (SELECT src_ip, list_reduce(list_prepend({{'next': 1::BIGINT, 'seen': []::BIGINT[], 'i': 0::BIGINT}}, list_transform(range(1, len(jumps) + 1), lambda k: {{'next': 0::BIGINT, 'seen': []::BIGINT[], 'i': k}})),
      lambda a, e: CASE WHEN a.next = e.i THEN {{'next': e.i + jumps[e.i], 'seen': CASE WHEN jumps[e.i] > 1 THEN list_append(a.seen, e.i) ELSE a.seen END, 'i': e.i}} ELSE {{'next': a.next, 'seen': a.seen, 'i': e.i}} END).seen AS seen FROM w),
    q AS (SELECT src_ip, i AS start, unnest(c).i AS i FROM c JOIN (SELECT src_ip, unnest(seen) AS i FROM v) USING (src_ip, i)),
    cr AS (SELECT src_ip, dst_ip, round(avg((abs(size - 541) <= 30 OR abs(size - 1082) <= 60 OR abs(size - 1623) <= 90)::INT), 4) AS ratio FROM packets GROUP BY ALL HAVING count(*) >= 20),
    a AS (SELECT src_ip, start, string_agg(dst_ip, ',' ORDER BY start_time, flow_id) AS hops, count(*)::INT AS n_hops, arg_min(dst_ip, (start_time, flow_id)) AS guard_ip, arg_max(dst_ip, (start_time, flow_id)) AS exit_ip,
      arg_min(flow_id, (start_time, flow_id)) AS first, min(start_time) AS start_time, round((max(start_time) - min(start_time)) * 1000, 1) AS build_ms, sum(packet_count)::BIGINT AS packets, sum(total_bytes)::BIGINT AS bytes,
      round(greatest(0.0, max(start_time + session_duration) - min(start_time)), 2) AS duration, round(avg(coalesce(ratio, 0.0)), 3) AS cell_ratio FROM q JOIN x USING (src_ip, i) LEFT JOIN cr USING (src_ip, dst_ip) GROUP BY src_ip, start)
    SELECT substr(md5(concat_ws(':', src_ip, hops, first)), 1, 12) AS circuit_id, src_ip, hops, n_hops, guard_ip, exit_ip, start_time, build_ms, packets, bytes, duration, cell_ratio, round(least(100.0, 55 + n_hops * 8 + cell_ratio * 20), 3) AS score FROM a""",
)

# -- scans of sources and of alerts, cut at pauses

_add(
    "sequential_access",
    _on("flows", lateral.detect_sequential),
    duck("flows") + f""", l AS (SELECT src_ip, list({{'t': start_time, 'd': dst_ip, 'p': dst_port}} ORDER BY start_time, flow_id) AS l FROM flows WHERE {_internal('src_ip')} AND {_internal('dst_ip')} GROUP BY src_ip),
    r AS (SELECT src_ip, list_reduce(list_prepend({{'e': l[1], 'seen': []::VARCHAR[], 'p': 0, 'began': 0.0::DOUBLE, 'last': -1e18::DOUBLE, 'done': []::STRUCT(seen VARCHAR[], p INT, s DOUBLE)[]}},
      list_transform(list_append(l, {{'t': 1e18::DOUBLE, 'd': '', 'p': 0}}), lambda x: {{'e': x, 'seen': []::VARCHAR[], 'p': 0, 'began': 0.0::DOUBLE, 'last': 0.0::DOUBLE, 'done': []::STRUCT(seen VARCHAR[], p INT, s DOUBLE)[]}})),
      lambda a, x: CASE WHEN x.e.t - a.last > 30 THEN {{'e': x.e, 'seen': [x.e.d], 'p': x.e.p, 'began': x.e.t, 'last': x.e.t, 'done': CASE WHEN len(a.seen) >= 5 THEN list_append(a.done, {{'seen': a.seen, 'p': a.p, 's': a.last - a.began}}) ELSE a.done END}}
        WHEN list_contains(a.seen, x.e.d) THEN a ELSE {{'e': x.e, 'seen': list_append(a.seen, x.e.d), 'p': a.p, 'began': a.began, 'last': x.e.t, 'done': a.done}} END).done AS done FROM l),
    d AS (SELECT src_ip, unnest(done) AS u FROM r)
    SELECT src_ip, list_min(u.seen) AS dst_ip, u.p AS dst_port, len(u.seen) AS targets, round(u.s, 3) AS seconds, least(100, 60 + 5 * len(u.seen)) AS score FROM d""",
)
_add(
    "alert_groups",
    _alerts(lambda a: correlation.timed_groups(a, "src_ip", seconds=30 * 86400.0)),
    _AL + """, l AS (SELECT src_ip, list({'t': created, 'id': alert_id} ORDER BY created, alert_id) AS l FROM al GROUP BY src_ip),
    r AS (SELECT src_ip, list_reduce(list_prepend({'e': l[1], 's': -1e18::DOUBLE, 'no': -1::BIGINT, 'out': []::STRUCT(id VARCHAR, t DOUBLE, no BIGINT)[]}, list_transform(l, lambda x: {'e': x, 's': 0.0::DOUBLE, 'no': 0::BIGINT, 'out': []::STRUCT(id VARCHAR, t DOUBLE, no BIGINT)[]})),
      lambda a, x: CASE WHEN x.e.t - a.s > 2592000.0 THEN {'e': x.e, 's': x.e.t, 'no': a.no + 1, 'out': list_append(a.out, {'id': x.e.id, 't': x.e.t, 'no': a.no + 1})}
        ELSE {'e': x.e, 's': a.s, 'no': a.no, 'out': list_append(a.out, {'id': x.e.id, 't': x.e.t, 'no': a.no})} END).out AS out FROM l)
    SELECT src_ip, u.t AS created, u.id AS alert_id, u.no AS group_no FROM (SELECT src_ip, unnest(out) AS u FROM r)""",
)

# -- batches of packets, and folds of labelled flows


def _incremental(spark, sf_dir):
    """The protocols' packets one after the other, each batch late for the ones before."""
    packets = fixtures.packets(spark, sf_dir)
    state = Incremental(spark, shared_folder(spark), width=86_400.0)
    for number, protocol in enumerate(("TLS", "DNS", "TCP")):
        state.add(packets.where(F.col("protocol") == protocol), number)
    return state.beacons()


_add("incremental_beacons", _incremental, catalog.oracle_sql()["beacons"])
_add(
    "cross_validation_folds",
    _on("flows", lambda f: registry.folds(f.select("flow_id", "protocol"), "flow_id", "protocol")),
    duck("flows") + " SELECT flow_id, protocol, ((row_number() OVER (PARTITION BY protocol ORDER BY md5(concat('42:', flow_id)), flow_id) - 1) % 5)::INT AS fold FROM flows",
)


def _cross_validated(flows):
    label = F.when(F.col("dst_port").isin(4444, 8443), "beacon").when(F.col("dst_port").isin(445, 3389), "lateral").otherwise("benign")
    x = flows.select("flow_id", F.log1p("total_bytes").alias("bytes"), F.log1p("session_duration").alias("seconds"), (F.col("dst_port") / 65535).alias("port"), label.alias("label"))
    got = registry.cross_validate(x, ["bytes", "seconds", "port"])
    return flows.sparkSession.createDataFrame([(*got.values(),)], ", ".join(f"{m} double" for m in got))


_add("cross_validation", _on("flows", _cross_validated))

# -- attackers' infrastructure: alerts of an address and a category are a threat


def _threats(spark, sf_dir):
    a = fixtures.alerts(spark, sf_dir)
    kind = F.when(F.col("category") == "beacon", "malware_beaconing").when(F.col("category") == "lateral_movement", "lateral_movement").when(F.col("category") == "exfiltration", "abnormal_traffic_flow").otherwise(F.col("category"))
    text = F.concat(F.lit("seen "), "src_ip", F.lit(" > "), "dst_ip", F.lit(" asking Host"), F.col("assignee"), F.lit(".Example"))
    return a.groupBy("src_ip", F.expr("floor(created / 604800)").alias("week"), kind.alias("threat_type")).agg(
        F.min("alert_id").alias("threat_id"), F.max(F.col("price") / 1e6).alias("score"), F.min("session_id").alias("session_id"), F.min("created").alias("created"), F.collect_list(text).alias("evidence")
    )


_THREATS = duck("alerts") + r""", th AS (SELECT src_ip, CASE category WHEN 'beacon' THEN 'malware_beaconing' WHEN 'exfiltration' THEN 'abnormal_traffic_flow' ELSE category END AS threat_type, min(alert_id) AS threat_id, max(price / 1e6) AS score,
    min(session_id) AS session_id, min(created) AS created, list(concat('seen ', src_ip, ' > ', dst_ip, ' asking Host', assignee, '.Example')) AS evidence FROM alerts GROUP BY src_ip, floor(created / 604800), threat_type),
    ev AS (SELECT threat_id, unnest(evidence) AS t FROM th),
    tm AS (SELECT DISTINCT threat_id, unnest(regexp_extract_all(t, '\b(\d{1,3}(?:\.\d{1,3}){3})\b', 1)) AS ip FROM ev),
    ti AS (SELECT * FROM tm WHERE NOT regexp_matches(ip, '^(10[.]|127[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])')),
    nd AS (SELECT ip, arg_min(threat_type, (created, threat_id)) AS f, round(max(score), 3) AS confidence, string_agg(DISTINCT threat_type, ',' ORDER BY threat_type) AS threat_types, count(*) AS threats, count(DISTINCT session_id) AS sessions,
      min(created) AS first_seen, max(created) AS last_seen FROM ti JOIN th USING (threat_id) GROUP BY ip)"""
_over_threats = lambda f: lambda spark, sf_dir: f(_threats(spark, sf_dir))
_add(
    "infrastructure_nodes",
    _over_threats(infrastructure.infrastructure_nodes),
    _THREATS + " SELECT ip, CASE f WHEN 'malware_beaconing' THEN 'c2' WHEN 'lateral_movement' THEN 'relay' WHEN 'abnormal_traffic_flow' THEN 'exfil' WHEN 'dga' THEN 'c2' ELSE 'unknown' END AS node_type, * EXCLUDE (ip, f) FROM nd",
)
_LINKS = ", ln AS (SELECT DISTINCT l.src, ip AS dst FROM ti JOIN (SELECT threat_id, min(ip) AS src FROM ti GROUP BY threat_id) l USING (threat_id) WHERE ip <> l.src)"
_add("infrastructure_links", _over_threats(infrastructure.infrastructure_links), _THREATS + _LINKS + " SELECT src, dst FROM ln")
_add(
    "infrastructure_campaigns",
    _over_threats(infrastructure.infrastructure_campaigns),
    _THREATS.replace("WITH", "WITH RECURSIVE", 1) + _LINKS + """, e AS (SELECT src AS a, dst AS b FROM ln UNION SELECT dst, src FROM ln), rc(n, c) AS (SELECT a, a FROM e UNION SELECT e.b, rc.c FROM rc JOIN e ON e.a = rc.n WHERE rc.c <= e.b),
    co AS (SELECT n AS ip, min(c) AS campaign FROM rc GROUP BY n)
    SELECT campaign, count(*) AS nodes, max(confidence) AS confidence, min(first_seen) AS first_seen, max(last_seen) AS last_seen, (SELECT string_agg(DISTINCT k, ',' ORDER BY k) FROM (SELECT unnest(string_split(threat_types, ',')) AS k FROM nd n2 JOIN co c2 USING (ip) WHERE c2.campaign = co.campaign)) AS threat_types
    FROM nd JOIN co USING (ip) GROUP BY campaign HAVING count(*) >= 2""",
)
_add(
    "infrastructure_connections",
    _over_threats(lambda t: infrastructure.connections(t, infrastructure.infrastructure_nodes(t).orderBy(F.desc("confidence"), "ip").limit(200))),
    _THREATS + """, tp AS (SELECT ip FROM nd ORDER BY confidence DESC, ip LIMIT 200), pr AS (SELECT DISTINCT tp.ip AS ip, b.ip AS other FROM tp JOIN ti a USING (ip) JOIN ti b ON b.threat_id = a.threat_id AND b.ip <> tp.ip)
    SELECT ip, count(*) AS connections, array_to_string(list(other ORDER BY other)[:20], ',') AS some FROM pr GROUP BY ip""",
)

# -- growth of destinations, relay clients, ciphers, SQL functions

_GROWTH = ", fo AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY start_time, flow_id) - 1 AS position, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY start_time, flow_id) = 1 AS fresh, count(*) OVER (PARTITION BY src_ip) AS n FROM flows), gr AS (SELECT src_ip, position, n, (sum(fresh::INT) OVER (PARTITION BY src_ip ORDER BY position))::BIGINT AS destinations FROM fo), gw AS (SELECT src_ip, position, destinations FROM gr WHERE position % greatest(1, n // 10) = 0)"
_add("destination_growth", _on("flows", hunting.destination_growth), duck("flows") + _GROWTH + " SELECT * FROM gw")
_add(
    "destination_spread",
    _on("flows", hunting.destination_spread),
    duck("flows") + _GROWTH + ", md AS (SELECT src_ip, median(destinations) AS m FROM gw GROUP BY src_ip HAVING count(*) >= 3) SELECT src_ip, median(abs(destinations - m)) AS mad_destinations FROM gw JOIN md USING (src_ip) GROUP BY src_ip",
)


def _with_ciphers(f):
    pick = F.when(F.col("src_port") % 7 == 0, F.array(*map(F.lit, (0x1301, 0x1302, 0xC02C, 0xC030)))).when(F.col("src_port") % 7 == 1, F.array(*map(F.lit, (0x1301, 0x002F, 0x0035, 0x000A)))).otherwise(F.array(F.lit(0x1302), F.lit(0xC02B)))
    return f.withColumn("cipher_suites", F.when(F.col("tls_version").isNotNull(), pick)).withColumn("ja3", F.when(F.col("src_port") % 11 == 0, "c12f54a3b91eb38a1b4e3f1c3d4e5f6a").otherwise(F.col("ja3")))


_CIPHERS = duck("flows") + """, cf AS (SELECT * REPLACE (CASE WHEN src_port % 11 = 0 THEN 'c12f54a3b91eb38a1b4e3f1c3d4e5f6a' ELSE ja3 END AS ja3),
    CASE WHEN tls_version IS NOT NULL THEN CASE src_port % 7 WHEN 0 THEN [4865, 4866, 49196, 49200] WHEN 1 THEN [4865, 47, 53, 10] ELSE [4866, 49195] END END AS cipher_suites FROM flows)"""
_sign = lambda kind, keys, detail, rest, where: f"SELECT '{kind}' AS kind, arg_min(flow_id, (start_time, flow_id)) AS flow_id, arg_min(src_ip, (start_time, flow_id)) AS src_ip, arg_min(dst_ip, (start_time, flow_id)) AS dst_ip, arg_min(dst_port, (start_time, flow_id)) AS dst_port, min(start_time) AS start_time, arg_min({detail}, (start_time, flow_id)) AS detail, {rest} FROM cf WHERE {where} GROUP BY {keys}"
_AUTHORITIES = "(" + ", ".join(f"'{k}'" for k, v in R.RELAY_NODES.items() if v == "authority") + ")"
_NODES = "(" + ", ".join(f"'{k}'" for k in R.RELAY_NODES) + ")"
_add(
    "relay_client_fingerprints",
    _on("flows", lambda f: relay.relay_client_fingerprints(_with_ciphers(f))),
    _CIPHERS + " " + " UNION ALL ".join((
        _sign("ja3_match", "cf.src_ip, cf.ja3", "'Tor Browser 13.x'", "0.95::DOUBLE AS confidence, 'HIGH' AS severity, 88 AS score", "ja3 = 'c12f54a3b91eb38a1b4e3f1c3d4e5f6a'"),
        _sign("nosni_relay_port", "cf.src_ip, cf.dst_ip", "dst_port::VARCHAR", "0.8, 'HIGH', 72", f"protocol = 'TLS' AND coalesce(sni, '') = '' AND dst_port IN (9001, 9030, 9040, 9050, 9051, 9150, 443, 80) AND dst_ip IN {_NODES}"),
        _sign("directory", "cf.flow_id", "protocol", "0.9, 'CRITICAL', 80", f"dst_ip IN {_AUTHORITIES}"),
        _sign("cipher_match", "cf.src_ip", "len(cipher_suites)::VARCHAR", "0.7, 'MEDIUM', 62", "src_port % 7 = 0 AND cipher_suites IS NOT NULL"),
    )),
)
_add(
    "weak_ciphers",
    _on("flows", lambda f: tls.detect_weak_ciphers(_with_ciphers(f)).withColumn("weak", F.array_join(F.transform("weak", lambda c: c.cast("string")), ","))),
    _CIPHERS + " SELECT flow_id, src_ip, dst_ip, '47,53,10' AS weak FROM cf WHERE src_port % 7 = 1 AND cipher_suites IS NOT NULL",
)


def _by_sql(flows):
    spark = flows.sparkSession
    functions.register(spark, "net_")
    columns = ", ".join(f"net_{f}(sni) AS {c}" for f, c in (("label_entropy", "label_entropy"), ("consonant_ratio", "consonants"), ("dga_score", "dga"), ("base_domain", "base"), ("subdomain_entropy", "sub_entropy"), ("mean_label_length", "mean_label"), ("longest_label", "longest"), ("text_entropy", "text_entropy")))
    return spark.sql(f"SELECT sni, {columns} FROM (SELECT DISTINCT sni FROM {{flows}} WHERE sni IS NOT NULL)", flows=flows)


_add("sql_functions", _on("flows", _by_sql), catalog.oracle_sql()["domain_functions"])

# -- flows stored by day and session, and STIX objects by page


def _stored_session(spark, sf_dir):
    path = shared_folder(spark)
    storage.write_by_session(fixtures.flows(spark, sf_dir), path, "start_time", buckets=4, mode="overwrite", period="year")
    return storage.read_session(spark, path, "s3", 800_000_000.0, 850_000_000.0, buckets=4, period="year")


_add("session_read", _stored_session, duck("flows") + " SELECT * FROM flows WHERE session_id = 's3' AND start_time >= 800000000 AND start_time < 850000000")
_objects = lambda a: a.select(F.col("tenant_id").alias("collection"), F.concat_ws("--", "category", "src_ip").alias("stix_id"), F.col("category").alias("type"), F.col("created").alias("added"), F.col("alert_id").alias("line"))
_OBJECTS = duck("alerts") + ", ob AS (SELECT tenant_id AS collection, concat_ws('--', category, src_ip) AS stix_id, category AS type, created AS added, alert_id AS line FROM alerts WHERE tenant_id = 't1')"
_add(
    "stix_manifest",
    _on("alerts", lambda a: stix_store.stix_manifest(_objects(a), "t1")),
    _OBJECTS + " SELECT stix_id, type, min(added) AS date_added, max(added) AS version, count(*) AS versions, 'application/stix+json;version=2.1' AS media_type FROM ob GROUP BY ALL",
)
_add("stix_versions", _on("alerts", lambda a: stix_store.newest_versions(_objects(a), "t1")), _OBJECTS + " SELECT stix_id, type, max(added) AS added, arg_max(line, (added, line)) AS line FROM ob GROUP BY ALL")
_add(
    "stix_page",
    _on("alerts", lambda a: stix_store.stix_page(_objects(a), "t1", (880_000_000.0, ""), "dga", 50)[0]),
    _OBJECTS + " SELECT * FROM ob WHERE type = 'dga' AND (added, stix_id) > (880000000.0, '') ORDER BY added, stix_id LIMIT 50",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
