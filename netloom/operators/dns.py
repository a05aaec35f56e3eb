"""DNS tunnelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import reference as R


def domain_summary(packets: DataFrame) -> DataFrame:
    """Measures of each base domain; the base of every detector here."""
    q = packets.where("dns_query is not null and dns_query <> ''")
    q = q.select(S.base_domain("dns_query").alias("domain"), "dns_query", "dns_type", "src_ip", "timestamp", S.subdomain_entropy("dns_query").alias("e"), S.longest_label("dns_query").alias("longest"), F.length("dns_query").alias("n"))
    return q.groupBy("domain").agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg(F.when(F.col("e") > 0, F.col("e"))), 4).alias("entropy"),
        F.count_distinct("dns_query").alias("unique_names"),
        F.count_distinct("src_ip").alias("sources"),
        F.count_if(F.col("dns_type").isin("TXT", "NULL", "ANY")).alias("txt"),
        F.count_if(F.col("longest") > 30).alias("long"),
        F.round(F.avg("longest"), 2).alias("mean_longest"),
        F.sum("n").alias("bytes"),
        (F.max("timestamp") - F.min("timestamp")).alias("span"),
        F.min_by("src_ip", F.struct("timestamp", "dns_query")).alias("src_ip"),
    )


def detect_dns_tunnel(packets: DataFrame, min_queries: int = 5, max_rate: float = 50.0) -> DataFrame:
    """One row per alert: high_entropy, txt_abuse, long_labels, high_frequency,
    unique_subdomains and tool_signature."""
    d = domain_summary(packets)
    ratio, rate, unique = F.col("txt") / F.col("queries"), F.col("queries") / (F.col("span") / 60), F.col("unique_names") / F.col("queries")
    enough = F.col("queries") >= min_queries
    alert = lambda kind, ok, score, high: F.when(ok, F.struct(F.lit(kind).alias("alert_type"), F.round(F.least(score, F.lit(100.0)), 2).alias("score"), F.when(high, "HIGH").otherwise("MEDIUM").alias("confidence")))
    e = F.col("entropy")
    found = [
        alert("high_entropy", enough & (e > 4.0), 50 + (e - 4.0) * 20, e > 4.5),
        alert("txt_abuse", enough & (ratio > 0.3) & (F.col("txt") > 10), 40 + ratio * 60, ratio > 0.5),
        alert("long_labels", enough & (F.col("long") > F.col("queries") * 0.3), (45 + F.col("long") * 3).cast("double"), F.col("mean_longest") > 40),
        alert("high_frequency", (F.col("queries") >= 20) & (F.col("span") >= 1) & (F.when(F.col("span") >= 1, rate) > max_rate), 40 + rate * 0.5, rate > 100),
        alert("unique_subdomains", (F.col("queries") >= 20) & (unique > 0.8), 35 + unique * 40, unique > 0.95),
    ]
    # the rows of a domain's alerts from one summary
    x = d.select("domain", "src_ip", "queries", F.explode(F.array_compact(F.array(*found))).alias("a"))
    return x.select("a.alert_type", "domain", "src_ip", "queries", "a.score", "a.confidence").unionByName(tool_signatures(packets))


def tool_signatures(packets: DataFrame) -> DataFrame:
    q = packets.where("dns_query is not null").groupBy(F.lower("dns_query").alias("domain")).agg(F.min("src_ip").alias("src_ip"), F.count(F.lit(1)).alias("queries"))
    hit = reduce(lambda a, s: a | F.contains("domain", F.lit(s)), R.TUNNEL_SIGNATURES, F.lit(False))
    return q.where(hit).select(F.lit("tool_signature").alias("alert_type"), "domain", "src_ip", "queries", F.lit(95.0).alias("score"), F.lit("HIGH").alias("confidence"))
