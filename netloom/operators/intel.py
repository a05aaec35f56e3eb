"""Threat-intelligence joins and feed parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators.windows import ip_range_join, suffix_join

IPV4 = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"


def load_indicators(feed: DataFrame) -> DataFrame:
    """One row per (type, value): first and last seen, newest other fields."""
    at = F.col("last_seen")
    return feed.where("value is not null").groupBy("ioc_type", F.lower("value").alias("value")).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("source", at).alias("source"), F.max_by("severity", at).alias("severity"), F.max("confidence").alias("confidence"))


def enrich_flows(flows: DataFrame, indicators: DataFrame) -> DataFrame:
    """Flows with the indicators that their ends, name and fingerprint match."""
    of = lambda kind: indicators.where(F.col("ioc_type") == kind).select(F.lower("value").alias("_v")).distinct()
    out = flows
    for col, name in (("src_ip", "src_match"), ("dst_ip", "dst_match")):
        out = out.join(of("ip").withColumn(name, F.col("_v")), out[col] == F.col("_v"), "left").drop("_v")
    out = out.join(of("ja3").withColumn("ja3_match", F.col("_v")), F.lower("ja3") == F.col("_v"), "left").drop("_v")
    out = suffix_join(out, "sni", indicators.where("ioc_type = 'domain'")).withColumnRenamed("matched", "sni_match")
    return out.where("coalesce(src_match, dst_match, ja3_match, sni_match) is not null")


def geo_enrich(df: DataFrame, ip_col: str, blocks: DataFrame) -> DataFrame:
    x = df.withColumn("_n", S.ip_to_long(ip_col))
    return ip_range_join(x, "_n", blocks).drop("_n")


def read_relay_list(lines: DataFrame) -> DataFrame:
    """Addresses of relay feeds: ``ExitNode <ip>`` lines, plain addresses, ``#`` comments."""
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    ip = F.regexp_extract(text, r"^(?:ExitNode\s+)?(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    return lines.select(ip.alias("ip")).where("ip <> ''").distinct()


def addresses_in_text(threats: DataFrame, key: str, evidence: str = "evidence") -> DataFrame:
    """Addresses named in evidence strings, one row each."""
    x = threats.select(key, F.explode(evidence).alias("_t"))
    return x.select(key, F.explode(F.regexp_extract_all("_t", F.lit(IPV4), 1)).alias("ip")).distinct()
