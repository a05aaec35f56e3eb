"""Event ingest with quarantine, and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "packet": ("timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size int, ttl int, flags string", ("timestamp", "src_ip", "dst_ip")),
    "flow": ("flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, start_time double, session_duration double, packet_count int, total_bytes bigint", ("flow_id", "src_ip", "dst_ip")),
    "tls": ("timestamp double, src_ip string, dst_ip string, tls_version string, sni string, ja3 string, ja3s string", ("timestamp", "src_ip", "dst_ip")),
    "alert": ("alert_id string, severity string, category string, src_ip string, dst_ip string, threat_score double", ("alert_id", "severity")),
}


def ingest(lines: DataFrame, kind: str, tenant: str, sensor: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """JSON lines (``value``) as valid rows in an envelope, and the rejected lines:
    not JSON, a field of the wrong type, or a required field absent.  Unknown keys
    are dropped.  Works on streams too."""
    schema, required = SCHEMAS[kind]
    x = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    ok = F.coalesce(F.col("j").isNotNull() & F.col("j._bad").isNull(), F.lit(False))
    for c in required:
        ok = ok & F.col(f"j.{c}").isNotNull()
    good = x.where(ok).select("j.*").drop("_bad")
    envelope = {"tenant_id": F.lit(tenant), "sensor_id": F.lit(sensor), "schema_version": F.lit(version), "ingested_at": F.current_timestamp()}
    return good.withColumns(envelope), x.where(~ok).select("value")


def save_result(df: DataFrame, path: str, session_id: str, kind: str, created: float) -> None:
    """Appends a run's rows as JSON, in a folder per session and kind."""
    x = df.select(F.to_json(F.struct("*")).alias("row"), F.lit(float(created)).alias("created"), F.lit(session_id).alias("session_id"), F.lit(kind).alias("kind"))
    x.write.mode("append").partitionBy("session_id", "kind").parquet(path)


def latest_result(spark: SparkSession, path: str, session_id: str, kind: str) -> DataFrame:
    """The rows of the newest run of a session and kind; the folder is pruned."""
    x = spark.read.schema("row string, created double, session_id string, kind string").parquet(path).where((F.col("session_id") == session_id) & (F.col("kind") == kind))
    return x.join(F.broadcast(x.agg(F.max("created").alias("created"))), "created").select("row", "created")


def insert_new_alerts(batch: DataFrame, path: str) -> None:
    """Appends the alerts whose id is not stored yet: a batch delivered twice adds
    nothing.  For ``foreachBatch``."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["alert_id"])
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        fresh = fresh.join(spark.read.parquet(path).select("alert_id"), "alert_id", "left_anti")
    fresh.write.mode("append").parquet(path)
