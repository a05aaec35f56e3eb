"""Small summaries that dashboards read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_summary(flows: DataFrame) -> DataFrame:
    """One row of counters per session."""
    named = F.when(F.col("sni") != "", F.col("sni"))
    return flows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"), F.sum("packet_count").alias("packets"), F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_ip").alias("destinations"),
        F.count_if(F.col("protocol") == "TLS").alias("tls_flows"), F.count_if(F.col("protocol") == "DNS").alias("dns_flows"), F.count_distinct(named).alias("names"), F.count_distinct("ja3").alias("fingerprints"),
        F.min("start_time").alias("first_seen"), F.max(F.col("start_time") + F.col("session_duration")).alias("last_seen"),
    )


def severity_breakdown(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"), F.max("score").alias("top_score"), F.count_distinct("technique").alias("techniques"))


def top_techniques(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.groupBy("technique").agg(F.count(F.lit(1)).alias("alerts")).orderBy(F.desc("alerts"), "technique").limit(n)


def category_timeline(alerts: DataFrame, width: int = 60) -> DataFrame:
    at = (F.floor(F.col("created") / width) * width).alias("bucket")
    return alerts.groupBy(at, "category", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def fingerprint_names(flows: DataFrame) -> DataFrame:
    """Names and versions below each client fingerprint."""
    return flows.where("ja3 is not null").groupBy("ja3", "sni", "tls_version").agg(F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"))


def endpoint_matrix(flows: DataFrame, by: str = "bytes", n: int = 30) -> DataFrame:
    """The top sources by one measure, every measure as a share of its largest value
    among all sources."""
    x = flows.groupBy("src_ip").agg(F.sum("total_bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"), F.count_distinct("dst_ip").alias("destinations"), F.count_distinct("dst_port").alias("ports"))
    cols = ("bytes", "flows", "destinations", "ports")
    top = x.agg(*[F.max(c).alias(f"_{c}") for c in cols])
    best = x.orderBy(F.desc(by), "src_ip").limit(n)
    return best.crossJoin(F.broadcast(top)).select("src_ip", *[F.round(F.coalesce(F.try_divide(F.col(c), F.col(f"_{c}")), F.lit(0.0)), 4).alias(c) for c in cols])


def indicator_counts(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("ioc_type").agg(F.count(F.lit(1)).alias("indicators"), F.count_distinct("source").alias("sources"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count_distinct("ip").alias("nodes"))
