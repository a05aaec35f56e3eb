"""Flows from packets and the traffic detectors, table to table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import reference as R
from netloom.operators.windows import first_by, gaps, group_entropy, mode, sliding


def with_flow_id(packets: DataFrame) -> DataFrame:
    """Bidirectional flow id from the two sorted ends and the protocol."""
    a = F.struct(F.col("src_ip").alias("i"), F.col("src_port").alias("p"))
    b = F.struct(F.col("dst_ip").alias("i"), F.col("dst_port").alias("p"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    text = F.concat(lo["i"], F.lit(":"), lo["p"].cast("string"), F.lit("-"), hi["i"], F.lit(":"), hi["p"].cast("string"), F.lit("-"), F.col("protocol"))
    return packets.withColumn("flow_id", F.substring(F.md5(text), 1, 16))


def aggregate_flows(packets: DataFrame, timeout: float | None = None) -> DataFrame:
    """Flows of packets: the first packet sets the direction.  With ``timeout`` a
    longer pause starts a new flow."""
    p = with_flow_id(packets)
    keys = ["flow_id"]
    if timeout is not None:
        w = W.partitionBy("flow_id").orderBy("timestamp", "packet_id")
        cut = (F.col("timestamp") - F.lag("timestamp").over(w) > timeout).cast("int")
        p = p.withColumn("_cut", F.coalesce(cut, F.lit(0))).withColumn("flow_part", F.sum("_cut").over(w))
        keys.append("flow_part")
    at = F.struct("timestamp", "packet_id")
    out = p.groupBy(*keys).agg(
        *[F.min_by(c, at).alias(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")],
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("size").alias("total_bytes"),
    )
    return out.withColumn("session_duration", F.col("end_time") - F.col("start_time")).withColumn("avg_packet_size", F.col("total_bytes") / F.col("packet_count"))


def detect_beacons(packets: DataFrame, flows: DataFrame | None = None, min_points: int = 5, min_gap: float = 0.05) -> DataFrame:
    """Flows whose gaps hardly vary: CV under .10, .25 or .40."""
    p = packets if "flow_id" in packets.columns else with_flow_id(packets)
    flows = aggregate_flows(packets) if flows is None else flows
    n = p.groupBy("flow_id").agg(F.count(F.lit(1)).alias("packet_count")).where(F.col("packet_count") >= min_points)
    g = gaps(p, ["flow_id"], "timestamp", min_gap, "packet_id").groupBy("flow_id").agg(F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"), F.count(F.lit(1)).alias("k")).where("k >= 3")
    cv = F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(1.0)
    x = g.join(n, "flow_id").withColumn("cv", cv)
    meta = flows.select("flow_id", "src_ip", "dst_ip", "dst_port", *[c for c in ("sni", "ja3") if c in flows.columns])
    out = x.join(meta, "flow_id", "left")
    extra = []
    if "ja3" in meta.columns:
        out = out.join(F.broadcast(R.malware_ja3(packets.sparkSession)), "ja3", "left")
        extra = ["ja3", "sni", F.col("malware").alias("malware_match"), S.dga_score("sni").alias("dga_score")]
    return beacon_rows(out, extra)


def beacon_rows(x: DataFrame, extra=()) -> DataFrame:
    """Rows of flows whose gaps have mean ``m``, deviation ``s`` and variation ``cv``."""
    return x.where("cv < 0.40").select(
        "flow_id", "src_ip", "dst_ip", "dst_port",
        F.round("m", 3).alias("interval_mean"), F.round("s", 3).alias("interval_stdev"),
        F.round(F.greatest(F.lit(0.0), 1 - F.col("cv")), 4).alias("regularity"), "packet_count",
        F.when(F.col("cv") < 0.10, "HIGH").when(F.col("cv") < 0.25, "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(F.col("m") < 10, "fast_beacon").when(F.col("m") < 60, "short_beacon").when(F.col("m") < 600, "medium_beacon").when(F.col("m") < 3600, "slow_beacon").otherwise("very_slow_beacon").alias("beacon_type"),
        *extra,
    )


def detect_bursts(packets: DataFrame, seconds: float = 5.0, factor: float = 3.0) -> DataFrame:
    """Trailing windows whose rate is over ``factor`` times the pair's mean rate."""
    keys = ["src_ip", "dst_ip"]
    pair = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("timestamp") - F.min("timestamp")).alias("span")).where("n >= 10 and span >= 1")
    x = sliding(packets.join(pair, keys), keys, "timestamp", seconds, count="count(1)", bytes="sum(size)", start="min(timestamp)")
    rate, mean = F.col("count") / seconds, F.col("n") / F.col("span")
    x = x.where((rate > factor * mean) & (F.col("count") >= 5)).withColumn("second", F.bround("start", 0))
    x = first_by(x, [*keys, "second"], ["timestamp", "packet_id"])
    return x.select(*keys, "second", "count", "bytes", F.round(rate / mean, 2).alias("ratio"), F.when(rate > 5 * mean, "HIGH").otherwise("MEDIUM").alias("severity"))


def detect_exfil(flows: DataFrame, min_sent: float = 10 * 1024 * 1024, min_ratio: float = 10.0) -> DataFrame:
    """Pairs that send far more than they get back, both directions tested."""
    sent = flows.groupBy("src_ip", "dst_ip").agg(F.sum("total_bytes").alias("sent"))
    back = sent.select(F.col("src_ip").alias("dst_ip"), F.col("dst_ip").alias("src_ip"), F.col("sent").alias("received"))
    x = sent.join(back, ["src_ip", "dst_ip"]).withColumn("ratio", F.col("sent") / F.col("received"))
    return x.where((F.col("sent") >= min_sent) & (F.col("received") > 0) & (F.col("ratio") >= min_ratio)).withColumn("ratio", F.round("ratio", 2))


def detect_ttl_anomalies(packets: DataFrame) -> DataFrame:
    """Sources whose TTLs vary, with the dominant TTL's likely system."""
    p = packets.where(F.col("ttl") > 0)
    x = p.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ttl").alias("n_ttl"), F.round(F.var_samp("ttl"), 2).alias("variance"))
    x = x.where("n >= 3 and (n_ttl > 3 or variance > 100)").join(mode(p, ["src_ip"], "ttl", "dominant_ttl"), "src_ip")
    return x.select("src_ip", "n", "n_ttl", "variance", "dominant_ttl", S.os_of_ttl("dominant_ttl").alias("os_guess"))


def detect_dga(flows: DataFrame, least: float = 0.6) -> DataFrame:
    """Names that look made by an algorithm; the first flow of each."""
    names = flows.where("sni is not null").groupBy("sni").agg(F.min_by(F.struct("flow_id", "src_ip"), F.struct("start_time", "flow_id")).alias("f"), F.count(F.lit(1)).alias("n_flows"))
    x = names.withColumn("score", S.dga_score("sni")).where(F.col("score") >= least)
    return x.select("sni", "f.flow_id", "f.src_ip", "n_flows", "score", S.label_entropy("sni").alias("entropy"), S.consonant_ratio("sni").alias("consonants"))


def endpoint_rows(flows: DataFrame) -> DataFrame:
    """Each flow once for either end: ``ip``, ``peer``, ``out``."""
    a = flows.withColumns({"ip": F.col("src_ip"), "peer": F.col("dst_ip"), "out": F.lit(True)})
    b = flows.withColumns({"ip": F.col("dst_ip"), "peer": F.col("src_ip"), "out": F.lit(False)}).where("src_ip <> dst_ip")
    return a.unionByName(b).where("ip is not null and ip <> ''")


def profile_endpoints(flows: DataFrame, ttl: DataFrame | None = None, beacons: DataFrame | None = None) -> DataFrame:
    """Profile and suspicion score 0-100 of each address, with reasons."""
    spark = flows.sparkSession
    rows = endpoint_rows(flows).join(F.broadcast(R.malware_ja3(spark)), "ja3", "left")
    odd = detect_dga(flows).select("sni", F.lit(True).alias("is_dga"))
    rows = rows.join(odd, "sni", "left")
    out = F.col("out")
    x = rows.groupBy("ip").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("total_bytes").alias("total_bytes"),
        F.count_distinct(F.when(out, F.col("peer"))).alias("fan_out"),
        F.count_distinct(F.when(~out, F.col("peer"))).alias("fan_in"),
        F.sum(F.when(out, F.col("total_bytes")).otherwise(0)).alias("ob"),
        F.sum(F.when(~out, F.col("total_bytes")).otherwise(0)).alias("ib"),
        F.coalesce(F.avg(F.when(F.col("session_duration") > 0, F.col("session_duration"))), F.lit(0.0)).alias("d"),
        F.avg((F.col("protocol") == "TLS").cast("double")).alias("tls"),
        F.max(F.col("malware").isNotNull()).alias("mal"),
        F.max(F.coalesce("is_dga", F.lit(False))).alias("dga"),
        F.max(out & F.col("dst_port").isin(*R.C2_PORTS)).alias("c2"),
    )
    pe = group_entropy(rows.where(out), ["ip"], "dst_port", "pe")
    x = x.join(pe, "ip", "left").withColumn("pe", F.coalesce("pe", F.lit(0.0)))
    marks = {"ttl_odd": ttl, "beacons": beacons}
    for name, df in marks.items():
        x = x.withColumn(name, F.lit(False)) if df is None else x.join(df.select(F.col("src_ip").alias("ip")).distinct().withColumn(name, F.lit(True)), "ip", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    ratio = F.when(F.col("ib") > 0, F.col("ob") / F.col("ib")).otherwise(0.0)
    rules = [
        ("malware_ja3", F.col("mal"), 40), ("many_destinations", F.col("fan_out") > 50, 20), ("many_flows", F.col("total_flows") > 100, 10),
        ("one_destination", (F.col("fan_out") == 1) & (F.col("total_flows") > 25), 20), ("c2_ports", F.col("c2"), 20),
        ("short_sessions", (F.col("d") < 2) & (F.col("total_flows") > 15), 10), ("all_tls", (F.col("tls") == 1) & (F.col("total_flows") > 10), 5),
        ("port_entropy", F.col("pe") > 3.5, 15), ("exfiltration", (ratio > 10) & (F.col("ob") > 5_000_000), 25), ("dga", F.col("dga"), 20),
        ("ttl", F.col("ttl_odd"), 10), ("beacon", F.col("beacons"), 15),
    ]
    score = sum((F.when(c, p).otherwise(0) for _, c, p in rules), F.lit(0))
    return x.select(
        "ip", "total_flows", "total_bytes", "fan_out", "fan_in", F.round("d", 2).alias("avg_session_duration"), F.round("tls", 3).alias("tls_ratio"),
        F.round("pe", 3).alias("port_entropy"), F.round(ratio, 2).alias("exfil_ratio"), F.least(score, F.lit(100)).alias("suspicion_score"),
        F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in rules])), ",").alias("reasons"),
    )


def label_flows(flows: DataFrame) -> DataFrame:
    """Rule-based label of each flow; the first rule that fits."""
    n, d = F.col("packet_count"), F.col("session_duration")
    bpp = F.col("total_bytes") / F.greatest(n, F.lit(1))
    label = (
        F.when((F.col("protocol") == "DNS") | (F.col("dst_port") == 53), "dns_query").when((n <= 3) & (d < 0.5), "scan_probe").when((bpp > 40_000) & (d > 5), "bulk_transfer")
        .when(d > 300, "persistent_session").when((n > 80) & (bpp < 500), "interactive").when(F.col("ja3").isNotNull(), "tls_encrypted").otherwise("standard")
    )
    return flows.withColumn("label", label)


def flow_clusters(flows: DataFrame) -> DataFrame:
    """Statistics of each label."""
    x = label_flows(flows)
    s = x.groupBy("label").agg(F.count(F.lit(1)).alias("flow_count"), F.round(F.avg("total_bytes"), 0).alias("avg_bytes"), F.round(F.avg("session_duration"), 2).alias("avg_duration"))
    s = s.join(mode(x, ["label"], "dst_port", "dominant_port"), "label").join(mode(x, ["label"], "dst_ip", "centroid_ip"), "label")
    return s.withColumn("cluster_id", F.row_number().over(W.orderBy("label")) - 1)


# -- aggregates


def protocol_stats(flows: DataFrame) -> DataFrame:
    return flows.groupBy("protocol").agg(F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"))


def top_endpoints(flows: DataFrame, side: str = "src_ip", n: int = 20) -> DataFrame:
    x = flows.groupBy(side).agg(F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"))
    return x.orderBy(F.desc("flows"), side).limit(n)


def timeline(packets: DataFrame, width: int = 60) -> DataFrame:
    return packets.groupBy((F.floor(F.col("timestamp") / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


def ja3_stats(flows: DataFrame, n: int = 30) -> DataFrame:
    at = F.struct("start_time", "flow_id")
    x = flows.where("ja3 is not null").groupBy("ja3").agg(F.count(F.lit(1)).alias("flows"), F.min_by("sni", at).alias("sni"), F.min_by("tls_version", at).alias("tls_version"))
    return x.join(F.broadcast(R.malware_ja3(flows.sparkSession)), "ja3", "left").orderBy(F.desc("flows"), "ja3").limit(n)


def dns_stats(packets: DataFrame, n: int = 50) -> DataFrame:
    x = packets.where("dns_query is not null").groupBy("dns_query", "dns_type").agg(F.count(F.lit(1)).alias("queries"))
    return x.orderBy(F.desc("queries"), "dns_query").limit(n).withColumn("dga_score", S.dga_score("dns_query"))


def connection_graph(flows: DataFrame, n: int | None = 200) -> DataFrame:
    x = flows.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"), F.min_by("protocol", F.struct("start_time", "flow_id")).alias("protocol"))
    return x if n is None else x.orderBy(F.desc("bytes"), "src_ip", "dst_ip").limit(n)


def graph_nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src_ip").alias("ip")).unionAll(edges.select(F.col("dst_ip").alias("ip")))
    return ends.groupBy("ip").agg(F.count(F.lit(1)).alias("degree")).withColumn("internal", S.is_internal("ip"))


def shared_fingerprints(flows: DataFrame) -> DataFrame:
    x = flows.where("ja3 is not null").groupBy("ja3").agg(F.count_distinct("src_ip").alias("n_sources"), F.count(F.lit(1)).alias("flows"))
    return x.where("n_sources > 1")


def shared_destinations(flows: DataFrame) -> DataFrame:
    return flows.groupBy("dst_ip").agg(F.count_distinct("src_ip").alias("n_sources")).where("n_sources > 2")


def repeated_sessions(flows: DataFrame, least: int = 5) -> DataFrame:
    x = flows.groupBy("src_ip", "dst_ip", "dst_port").agg(F.count(F.lit(1)).alias("sessions"), F.sum("total_bytes").alias("bytes"))
    return x.where(F.col("sessions") >= least)


def unusual_ports(flows: DataFrame, n: int = 20) -> DataFrame:
    x = flows.where(~F.col("dst_port").isin(*R.COMMON_PORTS)).groupBy("dst_port").agg(F.count(F.lit(1)).alias("flows"))
    return x.orderBy(F.desc("flows"), "dst_port").limit(n)


def tenant_stats(flows: DataFrame, exact: bool = True) -> DataFrame:
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return flows.groupBy("tenant_id").agg(distinct("src_ip").alias("endpoints"), F.sum("total_bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))


def encryption_stats(flows: DataFrame) -> DataFrame:
    """One row: encrypted flows, flows with a fingerprint, known malware's."""
    x = flows.join(F.broadcast(R.malware_ja3(flows.sparkSession)), "ja3", "left")
    return x.agg(F.count_if((F.col("protocol") == "TLS") | F.col("sni").isNotNull()).alias("encrypted"), F.count_if(F.col("ja3").isNotNull()).alias("with_ja3"), F.count_if(F.col("malware").isNotNull()).alias("malicious"), F.count(F.lit(1)).alias("flows"))


def session_totals(flows: DataFrame) -> DataFrame:
    return flows.groupBy("session_id").agg(F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"), F.sum("total_bytes").alias("bytes"))


def flows_page(flows: DataFrame, src: str | None = None, dst: str | None = None, protocol: str | None = None, has_sni: bool | None = None, has_ja3: bool | None = None, page: int = 1, limit: int = 50) -> DataFrame:
    """Newest flows that pass the filters, one page of them."""
    x = flows
    for col, value in (("src_ip", src), ("dst_ip", dst), ("protocol", protocol.upper() if protocol else None)):
        x = x if value is None else x.where(F.col(col) == value)
    for col, want in (("sni", has_sni), ("ja3", has_ja3)):
        x = x if want is None else x.where(F.col(col).isNotNull() if want else F.col(col).isNull())
    return x.orderBy(F.desc("start_time"), "flow_id").offset((page - 1) * limit).limit(limit)
