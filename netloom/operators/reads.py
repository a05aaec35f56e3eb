"""The reads behind list pages: packets, alerts, threats, and what they become.

Nulls: a null value passes no filter on its column; null addresses are left out of
lists.  Ties of equal times or scores are ordered by id, so a page is the same twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities from the gravest down.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
# DNS record types and TLS versions by their numbers.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA"}
TLS_VERSIONS = {769: "TLS 1.0", 770: "TLS 1.1", 771: "TLS 1.2", 772: "TLS 1.3"}


def recent_packets(packets: DataFrame, src_ip: str | None = None, protocol: str | None = None, n: int = 100) -> DataFrame:
    """The newest ``n`` packets, of one source or protocol if asked for."""
    for column, value in (("src_ip", src_ip), ("protocol", protocol)):
        if value is not None:
            packets = packets.where(F.col(column) == value)
    return packets.orderBy(F.desc("timestamp"), "packet_id").limit(n)


def severity_rank(severity: Column) -> Column:
    """0 for the gravest; null for an unknown severity."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.upper(severity))
    return F.when(place > 0, (place - 1).cast("int"))


def of_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """The scope that every read of a tenant starts from."""
    return rows.where(F.col("tenant_id") == tenant)


def query_alerts(alerts: DataFrame, tenant: str | None = None, statuses=(), severities=(), category: str | None = None, assignee: str | None = None, session: str | None = None, min_score: float | None = None, by: str = "severity") -> DataFrame:
    """Alerts that pass every filter given, with ``rank`` and in the order asked for:
    ``created`` (newest first), ``score`` (highest first) or ``severity``."""
    x = alerts if tenant is None else of_tenant(alerts, tenant)
    if statuses:
        x = x.where(F.col("status").isin(*statuses))
    if severities:
        x = x.where(F.upper("severity").isin(*[s.upper() for s in severities]))
    if category is not None:
        x = x.where(F.contains(F.lower("category"), F.lit(category.lower())))
    for column, value in (("assignee", assignee), ("session_id", session)):
        if value is not None:
            x = x.where(F.col(column) == value)
    if min_score is not None:
        x = x.where(F.col("threat_score") >= min_score)
    x = x.withColumn("rank", severity_rank(F.col("severity")))
    order = {"created": [F.desc("created")], "score": [F.desc("threat_score")], "severity": [F.asc_nulls_last("rank"), F.desc("created")]}[by]
    return x.orderBy(*order, "alert_id")


def filter_threats(threats: DataFrame, min_score: float = 0.0, kinds=(), severities=(), kind_col: str = "category", score_col: str = "score") -> DataFrame:
    x = threats.where(F.col(score_col) >= min_score)
    if kinds:
        x = x.where(F.col(kind_col).isin(*kinds))
    return x.where(F.col("severity").isin(*severities)) if severities else x


def notify_rows(alerts: DataFrame, severities=SEVERITIES[:2]) -> DataFrame:
    """``alert_id, severity, message`` of the alerts that somebody has to hear of."""
    text = F.format_string("[%s] %s from %s to %s", F.upper("severity"), F.col("category"), F.coalesce("src_ip", F.lit("-")), F.coalesce("dst_ip", F.lit("-")))
    return alerts.where(F.upper("severity").isin(*severities)).select("alert_id", F.upper("severity").alias("severity"), text.alias("message"))


def address_class(ip: Column) -> Column:
    """private, loopback, link_local, multicast, reserved or public by the octets;
    invalid where they are not four numbers up to 255."""
    o = F.transform(F.split(ip, r"\."), lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]{1,3}$")), x.cast("int")))
    a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    good = (F.size(o) == 4) & ~F.exists(o, lambda x: x.isNull() | (x > 255))
    kind = F.when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private").when(a == 127, "loopback").when((a == 169) & (b == 254), "link_local")
    return F.when(ip.isNotNull(), F.when(~good, "invalid").otherwise(kind.when(a.between(224, 239), "multicast").when((a == 0) | (a >= 240), "reserved").otherwise("public")))


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as UTC text with microseconds."""
    return F.date_format(F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def code_name(code: Column, names: dict[int, str]) -> Column:
    """The name of a numeric code; the number itself where it has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.element_at(table, code.cast("int")), code.cast("string")))


def merge_open_alerts(alerts: DataFrame, engine: str = "category", n: int = 3) -> DataFrame:
    """Open alerts with one category, pair of addresses (in either order) and engine
    are one: the first one's id, the highest score, how many there were and the
    evidence (ids) of the newest ``n``.  Only ``n`` ids a task and key are held:
    the newest are picked by rank, not gathered."""
    from pyspark.sql import Window as W

    ips = F.array_sort(F.array_compact(F.array("src_ip", "dst_ip")))
    key = F.md5(F.concat_ws("|", F.lower("category"), F.array_join(ips, ","), F.lower(engine)))
    x = alerts.where(~F.col("status").isin("resolved", "false_positive")).withColumn("key", key)
    whole = x.groupBy("key").agg(F.min_by("alert_id", F.struct("created", "alert_id")).alias("alert_id"), F.max("threat_score").alias("threat_score"), F.count(F.lit(1)).alias("n_alerts"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("created"), "alert_id"))
    newest = x.withColumn("place", place).where(F.col("place") <= n).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "alert_id"))), lambda s: s["alert_id"]), ",").alias("evidence"))
    return whole.join(newest, "key")


def threats_to_alerts(threats: DataFrame, engine: str, tenant: str) -> DataFrame:
    """Threat rows (src_ip, category, score, severity) as new alerts, named by what
    they say, so that a second run makes the same ids."""
    named = F.substring(F.md5(F.concat_ws("|", F.lit(tenant), F.lit(engine), "category", "src_ip")), 1, 16)
    return threats.select(named.alias("alert_id"), F.lit(tenant).alias("tenant_id"), F.lit(engine).alias("engine"), "src_ip", "category", "severity", F.round(F.col("score") * 100, 2).alias("threat_score"), F.lit("new").alias("status"))


def name_addresses(flows: DataFrame, name: str = "sni", address: str = "dst_ip") -> DataFrame:
    """``name, address, flows``: which names are served by which addresses, with how
    many names an address and how many addresses a name has."""
    pairs = flows.where(F.col(name).isNotNull() & F.col(address).isNotNull()).groupBy(F.lower(name).alias("name"), F.col(address).alias("address")).agg(F.count(F.lit(1)).alias("flows"))
    names = pairs.groupBy("address").agg(F.count(F.lit(1)).alias("names"))
    addresses = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("addresses"))
    return pairs.join(names, "address").join(addresses, "name").select("name", "address", "flows", "names", "addresses")


# Address ranges with a bad name.
SUSPICIOUS_RANGES = (r"^185\.220\.", r"^94\.102\.", r"^45\.142\.", r"^193\.32\.162\.")


def reputation(addresses: DataFrame, ip: str = "ip", patterns=SUSPICIOUS_RANGES) -> DataFrame:
    """``risk`` and ``flags``, the patterns that each address fits: internal
    addresses have none, others are ``high`` with a flag and ``unknown`` without."""
    kind = address_class(F.col(ip))
    inside = kind.isin("private", "loopback")
    flags = F.array_compact(F.array(*[F.when(F.regexp_like(F.col(ip), F.lit(p)) & ~inside, F.lit(p)) for p in patterns]))
    return addresses.withColumn("kind", kind).withColumn("flags", F.array_join(flags, ",")).withColumn("risk", F.when(inside, "internal").when(F.col("flags") != "", "high").otherwise("unknown"))


def mark_nodes(nodes: DataFrame, profiles: DataFrame, over: float = 40) -> DataFrame:
    """Nodes with ``suspicious``: whether their profile's score is over ``over``."""
    bad = profiles.where(F.col("suspicion_score") > over).select("ip", F.lit(True).alias("suspicious")).distinct()
    return nodes.join(bad, "ip", "left").withColumn("suspicious", F.coalesce("suspicious", F.lit(False)))


def sessions(flows: DataFrame, alerts: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest sessions with their flows, bytes and alerts.  Both sides are
    summed before they are joined."""
    x = flows.groupBy("session_id").agg(F.min("start_time").alias("started"), F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"))
    a = alerts.groupBy("session_id").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    return x.join(a, "session_id", "left").fillna(0, ["alerts", "critical"]).orderBy(F.desc("started"), "session_id").limit(n)


def tenant_overview(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Distinct sources and sessions, bytes, alerts and open alerts of each tenant
    that has flows."""
    f = flows.groupBy("tenant_id").agg(F.count_distinct("src_ip").alias("sources"), F.count_distinct("session_id").alias("sessions"), F.sum("total_bytes").alias("bytes"))
    a = alerts.groupBy("tenant_id").agg(F.count_distinct("alert_id").alias("alerts"), F.count_if(F.col("status") != "resolved").alias("open_alerts"))
    return f.join(a, "tenant_id", "left").fillna(0, ["alerts", "open_alerts"])


def known_flags(nodes: DataFrame, ip: str = "ip", **sets: DataFrame) -> DataFrame:
    """A boolean column for each set: whether the address is in it."""
    for name, rows in sets.items():
        nodes = nodes.join(rows.select(F.col("ip").alias(ip)).distinct().withColumn(name, F.lit(True)), ip, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return nodes
