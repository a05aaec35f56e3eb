"""Alerts: roll-ups, de-duplication, metrics and export lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators.windows import first_by

VENDOR, PRODUCT, VERSION = "Netloom", "Analytics", "1.0"


def dashboard(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("tenant_id", "severity", "status").agg(F.count(F.lit(1)).alias("alerts"), F.round(F.avg("threat_score"), 4).alias("mean_score"))


def hourly(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy((F.floor(F.col("created") / 3600) * 3600).alias("hour")).agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))


def active_alerts(alerts: DataFrame, limit: int | None = 100) -> DataFrame:
    """Open alerts by severity, then score."""
    x = alerts.where(F.col("status").isin("new", "triaged", "open", "investigating"))
    x = x.orderBy(F.desc(S.severity_rank("severity")), F.desc("threat_score"), "alert_id")
    return x if limit is None else x.limit(limit)


def deduplicate(alerts: DataFrame, keys=("src_ip", "dst_ip", "category", "session_id")) -> DataFrame:
    """One alert for each key: the first, with the highest score and a count."""
    best = alerts.groupBy(*keys).agg(F.max("threat_score").alias("max_score"), F.count(F.lit(1)).alias("n_alerts"))
    return first_by(alerts, [*keys], ["created", "alert_id"]).join(best, [*keys]).select("alert_id", *keys, "max_score", "n_alerts")


def with_sla(alerts: DataFrame, as_of: float) -> DataFrame:
    """Deadline by severity and whether it is breached at ``as_of`` (or was when
    the alert was resolved)."""
    due = F.col("created") + S.sla_hours("severity") * 3600.0
    done = F.when(F.col("status") == "resolved", F.col("resolved")).otherwise(F.lit(as_of))
    return alerts.withColumn("sla_deadline", due).withColumn("sla_breached", done > F.col("sla_deadline"))


def metrics(alerts: DataFrame, as_of: float) -> DataFrame:
    """One row a tenant: counts, mean hours to resolve, share within the SLA."""
    x = with_sla(alerts, as_of)
    done = F.col("status") == "resolved"
    return x.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~done).alias("open"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.round(F.avg(F.when(done, (F.col("resolved") - F.col("created")) / 3600)), 4).alias("mttr_hours"), F.round(F.avg((~F.col("sla_breached")).cast("double")), 4).alias("sla_rate"),
    )


def workload(alerts: DataFrame) -> DataFrame:
    return alerts.where("status <> 'resolved'").groupBy("assignee").agg(F.count(F.lit(1)).alias("open_alerts"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("urgent"))


def unified_threats(alerts: DataFrame, least: int = 2) -> DataFrame:
    """Alerts joined on either address: two or more make a threat, more engines
    raise its score (8 each after the first, 20 at most)."""
    ends = alerts.withColumn("ip", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))))
    x = ends.groupBy("ip").agg(F.count(F.lit(1)).alias("n_alerts"), F.count_distinct("category").alias("n_categories"), F.max("threat_score").alias("top"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    score = F.least(F.lit(100.0), F.col("top") + F.least(F.lit(20), 8 * (F.col("n_categories") - 1)))
    x = x.where(F.col("n_alerts") >= least).withColumn("score", F.round(score, 4))
    return x.select("ip", "n_alerts", "categories", "score", S.severity_of("score", (80, 60, 40)).alias("severity"), S.short_id(F.lit("threat"), "ip").alias("threat_id"))


# -- export lines; a missing column is an error, a null value becomes its default


def _text(col: str, default: str = "") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(default))


def _cef_severity() -> Column:
    r = S.severity_rank("severity")
    return F.when(r == 4, 10).when(r == 3, 8).when(r == 2, 5).when(r == 1, 3).otherwise(1)


def to_cef(alerts: DataFrame) -> DataFrame:
    escape = lambda c: F.regexp_replace(c, r"([|\\])", r"\\$1")
    head = F.concat(F.lit(f"CEF:0|{VENDOR}|{PRODUCT}|{VERSION}|"), escape(_text("category", "network")), F.lit("|"), escape(_text("title", "Unknown Alert")), F.lit("|"), _cef_severity().cast("string"))
    ext = F.concat(F.lit("|src="), _text("src_ip", "-"), F.lit(" dst="), _text("dst_ip", "-"), F.lit(" act="), _text("status", "open"), F.lit(" cs1="), _text("alert_id"), F.lit(" cs1Label=AlertID cfp1="), _text("threat_score", "0"), F.lit(" cfp1Label=ThreatScore"))
    return alerts.select("alert_id", F.concat(head, ext).alias("line"))


def to_leef(alerts: DataFrame) -> DataFrame:
    parts = [F.concat(F.lit(f"{k}="), _text(c, d)) for k, c, d in (("src", "src_ip", "-"), ("dst", "dst_ip", "-"), ("sev", "severity", "MEDIUM"), ("cat", "category", "network"), ("score", "threat_score", "0"))]
    return alerts.select("alert_id", F.concat(F.lit(f"LEEF:2.0|{VENDOR}|{PRODUCT}|{VERSION}|"), _text("title", "Unknown"), F.lit("|"), F.concat_ws("\t", *parts)).alias("line"))


def to_syslog(alerts: DataFrame, facility: int = 10, severity: int = 3) -> DataFrame:
    at = F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.concat(F.lit(f"<{facility * 8 + severity}>1 "), at, F.lit(" netloom alerts - "), _text("alert_id", "-"), F.lit(' - [alert severity="'), _text("severity", "MEDIUM"), F.lit('" category="'), _text("category"), F.lit('"] '), _text("title", "Alert"))
    return alerts.select("alert_id", text.alias("line"))


def to_json_documents(alerts: DataFrame, index: str = "alerts") -> DataFrame:
    body = F.struct(F.lit(index).alias("index"), F.struct("alert_id", "severity", "category", "src_ip", "dst_ip", "threat_score", "status").alias("event"))
    return alerts.select("alert_id", F.to_json(body).alias("line"))


def export(alerts: DataFrame, fmt: str, severity: str | None = None, session: str | None = None, limit: int | None = None) -> DataFrame:
    x = alerts if severity is None else alerts.where(F.upper("severity") == severity.upper())
    x = x if session is None else x.where(F.col("session_id") == session)
    x = x if limit is None else x.orderBy(F.desc("created"), "alert_id").limit(limit)
    return {"cef": to_cef, "leef": to_leef, "syslog": to_syslog, "json": to_json_documents}[fmt](x)
