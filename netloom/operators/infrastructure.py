"""Attackers' infrastructure: addresses that are named together in threats' evidence.

A threat that names thousands of addresses is a star around its least one, never all
their pairs; pairs are only made for a stated set of addresses or names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import connected_components
from netloom.operators.intel import IPV4

NAME = r"\b([a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{2,})\b"
# What a node is, by the kind of the threat that first names it.
NODE_TYPES = {"malware_beaconing": "c2", "tor_c2": "proxy", "lateral_movement": "relay", "suspicious_encrypted_session": "c2", "abnormal_traffic_flow": "exfil", "dga": "c2"}


def is_private(ip: Column) -> Column:
    return F.regexp_like(ip, F.lit(r"^(10[.]|127[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])"))


def evidence_terms(threats: DataFrame, evidence: str = "evidence") -> DataFrame:
    """``threat_id, kind, value``: public addresses and, in lower case, names of more
    than four characters in the evidence strings, once a threat."""
    x = threats.select("threat_id", F.explode(evidence).alias("_t"))
    found = lambda pattern, kind: x.select("threat_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("_t", F.lit(pattern), F.lit(1))).alias("value"))
    ips = found(IPV4, "ip").where(~is_private(F.col("value")))
    names = found(NAME, "domain").where(F.length("value") > 4).withColumn("value", F.lower("value"))
    return ips.unionByName(names).distinct()


def _named(threats: DataFrame, evidence: str) -> DataFrame:
    return evidence_terms(threats, evidence).where("kind = 'ip'").select("threat_id", F.col("value").alias("ip"))


def infrastructure_nodes(threats: DataFrame, evidence: str = "evidence") -> DataFrame:
    """``ip, node_type, confidence, threat_types, threats, sessions, first_seen, last_seen``.
    Threats need threat_id, threat_type, score, session_id and created; the earliest
    threat (of equal times the least id) gives a node its type."""
    of = threats.select("threat_id", "threat_type", "score", "session_id", "created")
    x = _named(threats, evidence).join(of, "threat_id")
    y = x.groupBy("ip").agg(
        F.min_by("threat_type", F.struct("created", "threat_id")).alias("_first"), F.round(F.max("score"), 3).alias("confidence"), F.count(F.lit(1)).alias("threats"), F.count_distinct("session_id").alias("sessions"),
        F.min("created").alias("first_seen"), F.max("created").alias("last_seen"),
    )
    # kinds of threat are few: their distinct rows are joined, not gathered from all rows
    kinds = x.select("ip", "threat_type").distinct().groupBy("ip").agg(F.array_join(F.sort_array(F.collect_list("threat_type")), ",").alias("threat_types"))
    kind = F.create_map(*[F.lit(v) for kv in NODE_TYPES.items() for v in kv])[F.col("_first")]
    return y.join(kinds, "ip").select("ip", F.coalesce(kind, F.lit("unknown")).alias("node_type"), "confidence", "threat_types", "threats", "sessions", "first_seen", "last_seen")


def infrastructure_links(threats: DataFrame, evidence: str = "evidence") -> DataFrame:
    """``src, dst``: each threat's least address and its others."""
    x = _named(threats, evidence)
    least = x.groupBy("threat_id").agg(F.min("ip").alias("src"))
    return x.join(least, "threat_id").where("ip <> src").select("src", F.col("ip").alias("dst")).distinct()


def infrastructure_campaigns(threats: DataFrame, evidence: str = "evidence", least: int = 2) -> DataFrame:
    """Connected addresses: ``campaign`` (the least one), nodes, confidence, threat_types."""
    of = connected_components(infrastructure_links(threats, evidence))
    x = infrastructure_nodes(threats, evidence).join(of, F.col("ip") == F.col("node"))
    kinds = x.select("component", F.explode(F.split("threat_types", ",")).alias("_k")).distinct().groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("_k")), ",").alias("threat_types"))
    y = x.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return y.where(F.col("nodes") >= least).join(kinds, "component").withColumnRenamed("component", "campaign")


def connections(threats: DataFrame, ips: DataFrame, evidence: str = "evidence", most: int = 20) -> DataFrame:
    """Of the addresses ``ip`` asked for: how many others share a threat with them, and
    the first ``most`` of those by text."""
    x = _named(threats, evidence)
    asked = x.join(ips.select("ip").distinct(), "ip").select("threat_id", F.col("ip").alias("_asked"))
    pairs = asked.join(x, "threat_id").where("ip <> _asked").select("_asked", "ip").distinct()
    # in parts first, so that no address's others are gathered whole
    part = F.pmod(F.xxhash64("ip"), F.lit(16))
    some = lambda c: F.slice(F.sort_array(c), 1, most)
    parts = pairs.groupBy("_asked", part.alias("_part"), "ip").count().groupBy("_asked", "_part").agg(F.count(F.lit(1)).alias("n"), F.collect_list("ip").alias("ips"))
    y = parts.select("_asked", "n", some("ips").alias("ips")).groupBy("_asked").agg(F.sum("n").alias("connections"), F.flatten(F.collect_list("ips")).alias("ips"))
    return y.select(F.col("_asked").alias("ip"), "connections", F.array_join(some("ips"), ",").alias("some"))


def name_links(threats: DataFrame, names: DataFrame, evidence: str = "evidence") -> DataFrame:
    """``domain, addresses, threats`` for the names asked for: addresses in the same threats."""
    x = evidence_terms(threats, evidence)
    asked = x.where("kind = 'domain'").select("threat_id", F.col("value").alias("domain")).join(names.select("domain").distinct(), "domain")
    y = asked.join(x.where("kind = 'ip'").select("threat_id", "value"), "threat_id")
    return y.groupBy("domain").agg(F.count_distinct("value").alias("addresses"), F.count_distinct("threat_id").alias("threats"))
