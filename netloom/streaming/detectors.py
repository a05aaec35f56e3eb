"""The windowed detectors as Structured Streaming transformations.

Each takes a streaming (or batch) table and returns one; the caller chooses
source, sink and trigger.  ``ts`` is an event-time timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOW_JSON = "tenant_id string, flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, start_time double, session_duration double, total_bytes bigint, packet_count int"


def decode_flows(raw: DataFrame, col: str = "value") -> DataFrame:
    """JSON lines to flow rows with an event time; rows that don't parse go."""
    x = raw.select(F.from_json(F.col(col).cast("string"), FLOW_JSON, {"mode": "PERMISSIVE"}).alias("f")).select("f.*")
    return x.where("src_ip is not null and dst_ip is not null and start_time is not null").withColumn("ts", F.timestamp_seconds("start_time"))


def wide_sources(flows: DataFrame, least: int = 10, width: str = "5 minutes", late: str = "15 minutes") -> DataFrame:
    """Sources with many distinct destinations in a tumbling window: a state a pair,
    then a count a source, so no state grows with a source's destinations."""
    pairs = flows.withWatermark("ts", late).groupBy(F.window("ts", width), "tenant_id", "src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n"))
    x = pairs.groupBy(F.window(F.window_time("window"), width), "tenant_id", "src_ip").agg(F.count("dst_ip").alias("destinations"))
    return x.where(F.col("destinations") >= least).select(F.col("window.start").alias("window_start"), "tenant_id", "src_ip", "destinations")


def fan_out(flows: DataFrame, least: int = 50, width: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Distinct edges of a window, then their out-degree: two chained aggregates."""
    edges = flows.withWatermark("ts", late).groupBy(F.window("ts", width), "tenant_id", "src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n"))
    x = edges.groupBy(F.window(F.window_time("window"), width), "tenant_id", "src_ip").agg(F.count(F.lit(1)).alias("out_degree"))
    return x.where(F.col("out_degree") > least).select(F.col("window.start").alias("window_start"), "tenant_id", "src_ip", "out_degree")


def fast_exfil(flows: DataFrame, min_bytes: int = 50_000_000, max_seconds: float = 10.0) -> DataFrame:
    """Stateless: many bytes in a short flow."""
    return flows.where((F.col("total_bytes") > min_bytes) & (F.col("session_duration") < max_seconds))


def live_flows(packets: DataFrame, idle: str = "120 seconds", late: str = "5 minutes") -> DataFrame:
    """Flows from packets; a pause of ``idle`` ends one."""
    x = packets.withWatermark("ts", late).groupBy(F.session_window("ts", idle), "flow_id").agg(F.count(F.lit(1)).alias("packet_count"), F.sum("size").alias("total_bytes"))
    return x.select("flow_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "packet_count", "total_bytes")


def write_alerts_once(alerts: DataFrame, path: str, checkpoint: str, late: str = "1 hour"):
    """Append alerts, each id once although delivery is at least once.

    A batch that runs again writes the same folder, so it leaves nothing twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["alert_id"]).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
