"""Fingerprints of TLS, SSH and HTTP/2 clients and servers, and what they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import reference as R

SSH_PORTS = (22, 2222, 222, 2200, 22222)


def _known(flows: DataFrame, known: DataFrame | None, name: str) -> DataFrame:
    """``name, app, type`` of known fingerprints; by default those of malware."""
    if known is not None:
        return known
    return R.malware_ja3(flows.sparkSession).select(F.col("ja3").alias(name), F.col("malware").alias("app"), F.lit("malware").alias("type"))


def _named(x: DataFrame, known: DataFrame, name: str) -> DataFrame:
    kind = F.coalesce("type", F.lit("unknown"))
    risk = F.when(kind == "malware", "critical").when(kind == "tor", "high").when(kind == "tool", "medium").otherwise("low")
    return x.join(known, name, "left").withColumn("app", F.coalesce("app", F.lit("Unknown"))).withColumn("type", kind).withColumn("risk", risk)


def _with_few(x: DataFrame, rows: DataFrame, key: str, col: str, n: int, name: str) -> DataFrame:
    """``x`` with the first ``n`` values of each key by text; Spark keeps no more than
    ``n`` a key and task before they are shuffled."""
    place = F.row_number().over(W.partitionBy(key).orderBy(col))
    first = rows.where(F.col(col).isNotNull()).select(key, col).distinct().withColumn("_r", place).where(F.col("_r") <= n)
    of = first.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(col)), ",").alias(name))
    return x.join(of, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def ja3_fingerprints(flows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each client fingerprint with its application, span and risk."""
    rows = flows.where("ja3 is not null and ja3 <> ''")
    x = rows.groupBy("ja3").agg(
        F.count(F.lit(1)).alias("flows"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"),
        F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_ip").alias("destinations"), F.count_distinct("sni").alias("names"),
    )
    x = _with_few(x, rows, "ja3", "sni", 10, "some_names")
    return _named(x, _known(flows, known, "ja3"), "ja3")


def ja3s_fingerprints(flows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Server fingerprints; a missing one is the md5 of version and server cipher."""
    made = F.when(F.col("server_cipher").isNotNull() & (F.coalesce("tls_version_id", F.lit(0)) > 0), F.md5(F.concat_ws(",", F.col("tls_version_id").cast("string"), F.col("server_cipher").cast("string"), F.lit(""))))
    rows = flows.withColumn("ja3s", F.coalesce(F.nullif("ja3s", F.lit("")), made)).where("ja3s is not null")
    x = rows.groupBy("ja3s").agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("dst_ip").alias("servers"))
    x = _with_few(x, rows, "ja3s", "sni", 10, "some_names")
    known = known if known is not None else flows.sparkSession.createDataFrame([(k, v, "tool") for k, v in R.PROXY_JA3S.items()], "ja3s string, app string, type string")
    return _named(x, known, "ja3s")


def hassh_fingerprints(flows: DataFrame, known: DataFrame | None = None, infer: bool = False) -> DataFrame:
    """SSH client fingerprints of SSH flows.  ``infer`` gives flows without one a
    stand-in made of source, port and bytes."""
    made = F.md5(F.concat("src_ip", F.col("dst_port").cast("string"), F.col("total_bytes").cast("string"))) if infer else F.lit(None).cast("string")
    own = F.nullif("hassh", F.lit("")) if "hassh" in flows.columns else F.lit(None).cast("string")
    x = flows.where(F.col("dst_port").isin(*SSH_PORTS) | (F.col("protocol") == "SSH")).withColumn("hassh", F.coalesce(own, made)).where("hassh is not null")
    x = x.groupBy("hassh").agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_ip").alias("destinations"), F.min("start_time").alias("first_seen"))
    return _named(x, _known(flows, known, "hassh").limit(0) if known is None else known, "hassh")


def h2_fingerprints(flows: DataFrame) -> DataFrame:
    """Flows for each fingerprint of HTTP/2 settings."""
    x = flows.where(F.size("h2_settings") > 0).withColumn("h2", S.http2_fingerprint("h2_settings"))
    return x.groupBy("h2").agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("src_ip").alias("sources"))


def correlate_fingerprints(flows: DataFrame, known: DataFrame | None = None, many: int = 5) -> DataFrame:
    """Addresses with many client fingerprints, with a malware one, or with a
    malware one and SSH: ``ip, kind, fingerprints``."""
    bad = _known(flows, known, "ja3").where("type = 'malware'").select("ja3", F.lit(True).alias("_bad"))
    ssh = F.col("dst_port").isin(*SSH_PORTS) | (F.col("protocol") == "SSH")
    x = flows.join(bad, "ja3", "left").groupBy(F.col("src_ip").alias("ip"))
    x = x.agg(F.count_distinct("ja3").alias("fingerprints"), F.coalesce(F.bool_or("_bad"), F.lit(False)).alias("_bad"), F.bool_or(ssh).alias("_ssh"))
    of = lambda cond, kind: x.where(cond).select("ip", F.lit(kind).alias("kind"), "fingerprints")
    parts = [of(F.col("fingerprints") > many, "many_fingerprints"), of("_bad", "malware_client"), of("_bad and _ssh", "malware_and_ssh")]
    return reduce(DataFrame.unionByName, parts)


def registry_merge(registry: DataFrame, flows: DataFrame) -> DataFrame:
    """Fingerprints seen, added where absent; hits are counted over both."""
    seen = flows.where("ja3 is not null").groupBy(F.col("ja3").alias("hash")).agg(F.count(F.lit(1)).alias("hits"))
    return registry.select("hash", "hits").unionByName(seen).groupBy("hash").agg(F.sum("hits").alias("hits"))
