"""Reads that put finished tables together: timelines, posture, geography, combined runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import graph, traffic
from netloom.operators.infrastructure import is_private
from netloom.operators.intel import geo_enrich


def audit_query(audit: DataFrame, tenant: str, user: str | None = None, action: str | None = None, resource: str | None = None, since: float | None = None, limit: int = 100) -> DataFrame:
    """A tenant's newest audit rows; the tenant is no option."""
    x = audit.where(F.col("tenant_id") == tenant)
    for name, value in (("user_id", user), ("action", action), ("resource", resource)):
        x = x if value is None else x.where(F.col(name) == value)
    x = x if since is None else x.where(F.col("at") >= since)
    return x.orderBy(F.desc("at"), F.desc("audit_id")).limit(limit)


def anomalous_scores(scores: DataFrame, least: float = 0.6, score: str = "score") -> DataFrame:
    """Rows of at least ``least``, with the numbers of these and of all."""
    n = scores.agg(F.count(F.lit(1)).alias("total_flows"), F.count_if(F.col(score) >= least).alias("anomalous_count"))
    return scores.where(F.col(score) >= least).crossJoin(F.broadcast(n))


def talkers(flows: DataFrame, end: str = "dst_ip", by: str = "bytes", n: int = 10) -> DataFrame:
    """The addresses of one end with most bytes or flows."""
    x = flows.groupBy(F.col(end).alias("ip")).agg(F.sum("total_bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))
    return x.orderBy(F.desc(by), "ip").limit(n)


def geo_distribution(flows: DataFrame, blocks: DataFrame) -> DataFrame:
    """How often each country is an end of a flow; public addresses only, ``??`` where
    no block holds one.  Addresses are counted before they are looked up."""
    ends = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip <> ''").where(~is_private(F.col("ip")))
    x = geo_enrich(ends.groupBy("ip").agg(F.count(F.lit(1)).alias("n")), "ip", blocks)
    return x.groupBy(F.coalesce("country", F.lit("??")).alias("country")).agg(F.sum("n").alias("connections"), F.count(F.lit(1)).alias("addresses"))


def infrastructure_overview(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes of the attackers' infrastructure by type and country."""
    x = geo_enrich(nodes, "ip", blocks).groupBy("node_type", F.coalesce("country", F.lit("??")).alias("country"))
    return x.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("confidence"), 3).alias("total_confidence"), F.max("confidence").alias("top_confidence"), F.max("last_seen").alias("last_seen"))


def relay_counters(events: DataFrame) -> DataFrame:
    """One row: relay events by kind and severity."""
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("findings"))), F.lit(0)).alias(k)
    level = S.severity_of("score", (80, 65, 50))
    return events.agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("events"), *map(kind, ("relay_flow", "cell_sizes", "relay_c2", "relay_traffic")), F.count_distinct("src_ip").alias("sources"), *[F.count_if(level == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")])


def anomaly_timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """``kind, at, ip, detail`` of several detectors' rows, each with its own time."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "at", "ip", F.col("detail").cast("string").alias("detail")) for k, df in parts.items()])


def technique_lookup(techniques: DataFrame, technique: str) -> DataFrame:
    """A technique, or all below it (``T1071`` finds ``T1071.001``)."""
    return techniques.where((F.col("technique") == technique) | F.startswith("technique", F.lit(f"{technique}.")))


def threat_groups(alerts: DataFrame, most: int = 10) -> DataFrame:
    """Alerts of a detector and category together, with their first indicators by text."""
    named = alerts.select("engine", "category", "score", "src_ip", F.explode(F.array_compact(F.array("src_ip", "dst_ip"))).alias("ip"))
    seen = named.groupBy("engine", "category", "ip").agg(F.max("score").alias("_s"))
    # the first by text of each of 16 parts, then of those
    first = lambda c: F.slice(F.sort_array(c), 1, most)
    parts = seen.groupBy("engine", "category", F.pmod(F.xxhash64("ip"), F.lit(16)).alias("_p")).agg(F.count(F.lit(1)).alias("n"), first(F.collect_list("ip")).alias("ips"))
    of = parts.groupBy("engine", "category").agg(F.sum("n").alias("indicators"), F.array_join(first(F.flatten(F.collect_list("ips"))), ",").alias("some"))
    n = alerts.groupBy("engine", "category").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("src_ip").alias("sources"), F.max("score").alias("score"))
    return n.join(of, ["engine", "category"])


def posture(alerts: DataFrame) -> DataFrame:
    """One row of counters that compliance views show, from alerts and their assignees."""
    done, urgent = F.col("status") == "resolved", F.col("severity").isin("CRITICAL", "HIGH")
    x = alerts.agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(~done).alias("open"), F.count_if(urgent & ~done).alias("urgent_open"), F.count_if(done).alias("resolved"), F.count_distinct("assignee").alias("users"), F.count_distinct("tenant_id").alias("tenants"),
        F.round(F.avg(F.when(done, (F.col("resolved") - F.col("created")) / 3600)), 4).alias("mean_hours"),
    )
    share = F.when(F.col("alerts") > 0, F.col("resolved") / F.col("alerts")).otherwise(1.0)
    return x.withColumn("resolved_share", F.round(share, 4)).withColumn("state", F.when(share >= 0.9, "good").when(share >= 0.5, "fair").otherwise("poor"))


def graph_summary(edges: DataFrame, least: int = 3, **odd) -> DataFrame:
    """One row about the graph; none under ``least`` nodes.  ``odd``: thresholds of
    ``graph.structural_anomalies``."""
    d = graph.degrees(edges).agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("top_degree"), F.round(F.avg("degree"), 4).alias("mean_degree"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("bytes"), F.sum("flows").alias("flows"))
    a = graph.structural_anomalies(edges, **odd).agg(F.count(F.lit(1)).alias("anomalies"))
    x = d.crossJoin(e).crossJoin(a).where(F.col("nodes") >= least)  # one row each
    return x.withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6))


def analyze(packets: DataFrame, flows: DataFrame, min_sent: float = 10 * 1024 * 1024) -> dict[str, DataFrame]:
    """The base analysis by name; each is a plan that runs when it is asked for."""
    ttl, beacons = traffic.detect_ttl_anomalies(packets), traffic.detect_beacons(packets)
    return {
        "beacons": beacons, "bursts": traffic.detect_bursts(packets), "exfiltration": traffic.detect_exfil(flows, min_sent), "ttl_anomalies": ttl, "dga_domains": traffic.detect_dga(flows),
        "endpoints": traffic.profile_endpoints(flows, ttl, beacons), "protocols": traffic.protocol_stats(flows), "connections": traffic.connection_graph(flows), "dns": traffic.dns_stats(packets),
    }


def analysis_summary(packets: DataFrame, flows: DataFrame, **how) -> DataFrame:
    """``name, n``: how much the base analysis found."""
    found = analyze(packets, flows, **how)
    counts = {
        "total_flows": flows, "total_packets": packets, "beacons": found["beacons"].where("confidence <> 'LOW'"), "bursts": found["bursts"], "exfil_alerts": found["exfiltration"],
        "ttl_anomalies": found["ttl_anomalies"], "dga_domains": found["dga_domains"], "tls_flows": flows.where("protocol = 'TLS'"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in counts.items()])


def feature_rows(features: DataFrame, key: str) -> DataFrame:
    """Each entity's features by name, as rows; ``feature_map`` has them in one map."""
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features.columns if c != key])
    return features.select(key, F.explode(named).alias("_f")).select(key, "_f.feature", "_f.value")


def feature_map(features: DataFrame, key: str) -> DataFrame:
    cols = [c for c in features.columns if c != key]
    return features.select(key, F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))]).alias("features"))


def count_map(values: Column) -> Column:
    """Array to a map of value to count, in order of the values."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)))))


def byte_entropy(payload: Column, most: int | None = 256) -> Column:
    """Shannon entropy of the first ``most`` bytes, or with ``None`` of all, rounded to 4
    places; 0 without any."""
    # as ISO-8859-1 each byte is a character
    taken = payload if most is None else F.substring(payload, 1, most)
    return F.round(F.coalesce(S.entropy_of(F.decode(taken, "ISO-8859-1")), F.lit(0.0)), 4)


def flag_domains(events: DataFrame, indicators: DataFrame, domain: str = "domain") -> DataFrame:
    """Browser events whose domain, or a parent of it, is an indicator."""
    from netloom.operators.windows import suffix_join

    return suffix_join(events, domain, indicators).where("matched is not null")


def live_counters(packets: DataFrame, malware: DataFrame, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Counts of recent packets by window and protocol, streaming or not; ``packets``
    have ts, protocol, sni and ja3."""
    x = packets.withWatermark("ts", late).join(F.broadcast(malware.select("ja3").distinct().withColumn("_bad", F.lit(True))), "ja3", "left")
    y = x.groupBy(F.window("ts", width), "protocol").agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("sni") != "").alias("with_sni"), F.count_if(F.col("_bad")).alias("malware"))
    return y.select(F.col("window.start").cast("double").alias("start"), "protocol", "packets", "with_sni", "malware")
