"""Feeds that were downloaded as JSON lines, as tables.  Nothing here calls a service.

Every reader takes a DataFrame with a string column ``value`` (one document a row,
``spark.read.text(..., wholetext=True)`` or one per line); a document that is not
JSON, or lacks the address, gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = ("ip", "source", "score", "malicious", "categories", "tags", "country", "reports")
# Weights of the providers in a fused score.
WEIGHTS = {"abuse_reports": 0.4, "engines": 0.35, "pulses": 0.25}
RELAY_FLOOR = 70.0


def _none():
    return F.array().cast("array<string>")


def abuse_reports(docs: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Abuse reports: the provider's confidence; categories by ``names``, else
    ``category_<id>``."""
    d = "data struct<ipAddress string, abuseConfidenceScore double, countryCode string, totalReports bigint, isTor boolean, isWhitelisted boolean, reports array<struct<categories array<int>>>>"
    x = docs.select(F.from_json("value", d).alias("j")).select("j.data.*").where("ipAddress is not null")
    known = F.create_map(*[F.lit(v) for kv in (names or {}).items() for v in kv]) if names else F.lit(None).cast("map<int,string>")
    name = lambda c: F.coalesce(F.try_element_at(known, c), F.concat(F.lit("category_"), c.cast("string")))
    cats = F.sort_array(F.array_distinct(F.transform(F.flatten(F.transform(F.coalesce("reports", F.array().cast("array<struct<categories:array<int>>>")), lambda r: F.coalesce(r["categories"], F.array().cast("array<int>")))), name)))
    tags = F.array_compact(F.array(F.when(F.col("isTor"), "tor"), F.when(F.col("isWhitelisted"), "whitelisted")))
    score = F.coalesce("abuseConfidenceScore", F.lit(0.0))
    return x.select(F.col("ipAddress").alias("ip"), F.lit("abuse_reports").alias("source"), score.alias("score"), (score > 50).alias("malicious"), cats.alias("categories"), tags.alias("tags"), F.col("countryCode").alias("country"), F.coalesce("totalReports", F.lit(0)).alias("reports"))


def engines(docs: DataFrame) -> DataFrame:
    """Scanner verdicts: the share of engines that say malicious, in percent."""
    d = "data struct<id string, attributes struct<last_analysis_stats map<string,int>, tags array<string>, country string>>"
    x = docs.select(F.from_json("value", d).alias("j")).select("j.data.id", "j.data.attributes.*").where("id is not null")
    stats = F.coalesce("last_analysis_stats", F.create_map().cast("map<string,int>"))
    bad = F.coalesce(F.try_element_at(stats, F.lit("malicious")), F.lit(0))
    total = F.aggregate(F.map_values(stats), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    x = x.withColumn("_bad", bad).withColumn("_all", F.greatest(total, F.lit(1))).withColumn("score", F.round(100 * F.col("_bad") / F.col("_all"), 1))
    is_relay = F.exists(F.coalesce("tags", _none()), lambda t: F.contains(F.lower(t), F.lit("tor")))
    cats = F.array_compact(F.array(F.when(F.col("_bad") > 0, "malicious"), F.when(F.col("score") > 50, "high_risk"), F.when(is_relay, "tor")))
    return x.select(F.col("id").alias("ip"), F.lit("engines").alias("source"), "score", (F.col("_bad") > 3).alias("malicious"), cats.alias("categories"), _none().alias("tags"), "country", F.col("_bad").cast("bigint").alias("reports"))


_PULSE = "struct<id string, name string, author_name string, created string, TLP string, tags array<string>, adversary string, attack_ids array<struct<id string, display_name string>>, indicators array<struct<type string, indicator string, title string>>>"


def pulses(docs: DataFrame) -> DataFrame:
    """Community pulses about an address: 12 a pulse, 100 at most."""
    x = docs.select(F.from_json("value", f"indicator string, country_code string, pulse_info struct<count bigint, pulses array<{_PULSE}>>").alias("j")).select("j.*").where("indicator is not null")
    n, ps = F.coalesce("pulse_info.count", F.lit(0)), F.coalesce("pulse_info.pulses", F.array().cast(f"array<{_PULSE}>"))
    merged = lambda f: F.sort_array(F.array_distinct(F.flatten(F.transform(ps, lambda p: F.coalesce(f(p), _none())))))
    return x.select(
        F.col("indicator").alias("ip"), F.lit("pulses").alias("source"), F.least(F.lit(100.0), (n * 12).cast("double")).alias("score"), (n > 3).alias("malicious"),
        merged(lambda p: F.transform(p["attack_ids"], lambda a: a["display_name"])).alias("categories"), merged(lambda p: p["tags"]).alias("tags"), F.col("country_code").alias("country"), n.alias("reports"),
    )


def explode_pulses(docs: DataFrame) -> DataFrame:
    """One row per indicator of each pulse, with the pulse's technique ids."""
    p = docs.select(F.from_json("value", _PULSE).alias("p")).select("p.*").where("id is not null")
    x = p.withColumn("_i", F.explode("indicators"))
    return x.select(F.col("id").alias("pulse_id"), "name", F.coalesce("TLP", F.lit("white")).alias("tlp"), F.col("_i.type").alias("ioc_type"), F.col("_i.indicator").alias("value"), F.coalesce(F.transform("attack_ids", lambda a: a["id"]), _none()).alias("techniques"))


def relay_details(docs: DataFrame) -> DataFrame:
    """Relays of a directory document, one row per address: exit before guard
    before relay; an address that several relays share takes the first of these."""
    relay = "struct<nickname string, fingerprint string, or_addresses array<string>, flags array<string>, bandwidth_rate bigint, country string>"
    r = docs.select(F.explode(F.from_json("value", f"relays array<{relay}>")["relays"]).alias("r")).select("r.*")
    has = lambda f: F.coalesce(F.array_contains("flags", f), F.lit(False))
    kind = F.when(has("Exit"), F.struct(F.lit(0).alias("o"), F.lit("exit").alias("t"))).when(has("Guard"), F.struct(F.lit(1).alias("o"), F.lit("guard").alias("t"))).otherwise(F.struct(F.lit(2).alias("o"), F.lit("relay").alias("t")))
    x = r.select(F.explode("or_addresses").alias("a"), kind.alias("k"), "fingerprint", "country", "bandwidth_rate")
    ip = F.when(F.startswith("a", F.lit("[")), F.regexp_extract("a", r"^\[(.*)\]", 1)).otherwise(F.substring_index("a", ":", 1))
    best = F.min(F.struct("k", "fingerprint", "country", "bandwidth_rate")).alias("b")
    return x.groupBy(ip.alias("ip")).agg(best).select("ip", F.col("b.k.t").alias("node_type"), "b.fingerprint", "b.country", F.col("b.bandwidth_rate").alias("bandwidth"))


def fuse_reputation(results: DataFrame, nodes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per address: mean of its providers' scores by weight (0.1 for others).
    A relay's weighted sum is at least 70 before it is divided."""
    weight = F.coalesce(*[F.when(F.col("source") == s, w) for s, w in (weights or WEIGHTS).items()], F.lit(0.1))
    merged = lambda c: F.array_remove(F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))), "")
    x = results.withColumn("_w", weight).groupBy("ip").agg(F.sum(F.col("score") * F.col("_w")).alias("_s"), F.sum("_w").alias("_w"), merged("categories").alias("categories"), merged("tags").alias("tags"), F.count(F.lit(1)).alias("sources"))
    relay = nodes.groupBy("ip").agg(F.min("node_type").alias("node_type"))
    x = x.join(relay, "ip", "left")
    is_relay = F.col("node_type").isNotNull()
    total = F.when(is_relay, F.greatest("_s", F.lit(RELAY_FLOOR))).otherwise(F.col("_s"))
    score = F.round(F.coalesce(F.try_divide(total, F.col("_w")), F.lit(0.0)), 1)
    cats = F.when(is_relay, F.array_union("categories", F.array(F.lit("tor_node")))).otherwise(F.col("categories"))
    return x.select("ip", score.alias("score"), (score > 50).alias("malicious"), is_relay.alias("is_relay"), "node_type", cats.alias("categories"), "tags", "sources")
