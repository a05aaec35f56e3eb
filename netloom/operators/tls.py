"""Encrypted channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import reference as R
from netloom.operators.windows import first_by


def tls_versions(flows: DataFrame, n: int = 10) -> DataFrame:
    return flows.where("tls_version is not null").groupBy("tls_version").agg(F.count(F.lit(1)).alias("flows")).orderBy(F.desc("flows"), "tls_version").limit(n)


def detect_deprecated_tls(flows: DataFrame) -> DataFrame:
    x = flows.where(F.col("tls_version").isin(*R.DEPRECATED_TLS))
    return first_by(x, ["src_ip", "dst_ip", "tls_version"], ["start_time", "flow_id"]).select("src_ip", "dst_ip", "tls_version", "flow_id", "sni")


def detect_weak_ciphers(flows: DataFrame) -> DataFrame:
    weak = F.filter("cipher_suites", lambda c: c.isin(*R.WEAK_CIPHERS))
    return flows.withColumn("weak", weak).where(F.size("weak") > 0).select("flow_id", "src_ip", "dst_ip", "weak")


def detect_no_sni(flows: DataFrame, least: int = 3) -> DataFrame:
    x = flows.where("ja3 is not null and (sni is null or sni = '')").groupBy("src_ip")
    return x.agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("dst_ip").alias("destinations"), F.min("dst_ip").alias("dst_ip")).where(F.col("flows") >= least)


def detect_mitm(flows: DataFrame) -> DataFrame:
    """Fingerprints of intercepting proxies, on either side of the handshake."""
    known = flows.sparkSession.createDataFrame([*R.PROXY_JA3S.items()], "fingerprint string, tool string")
    cols = [c for c in ("ja3", "ja3s") if c in flows.columns]
    rows = flows.select("flow_id", "src_ip", "dst_ip", F.explode(F.array_distinct(F.array_compact(F.array(*cols)))).alias("fingerprint"))
    return rows.join(F.broadcast(known), "fingerprint")


def detect_ip_sni(flows: DataFrame) -> DataFrame:
    x = flows.where(F.regexp_like("sni", F.lit("^[0-9.]+$")))
    return first_by(x, ["src_ip", "dst_ip"], ["start_time", "flow_id"]).select("src_ip", "dst_ip", "sni", "flow_id")


def detect_uniform_sessions(flows: DataFrame, least: int = 15, max_cv: float = 0.15) -> DataFrame:
    d = F.when(F.col("session_duration") > 0, F.col("session_duration"))
    x = flows.where("ja3 is not null or protocol = 'TLS'").groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("flows"), F.count(d).alias("k"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    # the deviation's last digits depend on the order of the rows: without them a ratio at the threshold is on one side of it
    x = x.withColumn("cv", F.round(F.try_divide(F.coalesce("s", F.lit(0.0)), F.col("m")), 12))
    return x.where((F.col("flows") > least) & (F.col("k") >= 5) & (F.col("cv") < max_cv)).select("src_ip", "dst_ip", "flows", S.round_binary("m", 2).alias("mean_duration"), S.round_binary("cv", 3).alias("cv"))


def detect_unusual_port_tls(flows: DataFrame) -> DataFrame:
    x = flows.where("protocol = 'TLS' and dst_port > 0").where(~F.col("dst_port").isin(*R.TLS_PORTS))
    return first_by(x, ["src_ip", "dst_ip", "dst_port"], ["start_time", "flow_id"]).select("src_ip", "dst_ip", "dst_port", "flow_id")
