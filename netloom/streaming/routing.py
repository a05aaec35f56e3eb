"""Alerts from one stream to several sinks, each alert once in each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import correlation, reads, soc

#: A sink takes a batch's rows and the batch's number and may be called again with both.
Sink = Callable[[DataFrame, int], None]


def files(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sink:
    """Parquet in a folder for each batch, written whole or again: a batch that runs
    twice leaves its rows once.  Readers take the folder ``path``."""
    return lambda batch, number: shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")


def siem(path: str, fmt: str = "json") -> Sink:
    return files(path, lambda df: soc.export(df, fmt))


def webhook(path: str, severities: tuple[str, ...] = ("CRITICAL", "HIGH")) -> Sink:
    """The alerts that a notification is sent for."""
    return files(path, lambda df: reads.notify_rows(df.where(F.col("severity").isin(*severities))))


def stix(path: str) -> Sink:
    """An indicator for each address and technique of the alerts."""
    threats = lambda df: df.select(F.col("src_ip").alias("ip"), F.col("threat_score").alias("score"), F.col("technique").alias("techniques")).where("ip is not null and techniques is not null").distinct()
    return files(path, lambda df: correlation.to_stix(threats(df)))


def kafka_rows(alerts: DataFrame) -> DataFrame:
    """Rows of a Kafka sink: the tenant as key, so that a tenant's alerts keep their
    order; the alert's id as a header, by which a reader drops what comes twice."""
    header = F.array(F.struct(F.lit("alert_id").alias("key"), F.col("alert_id").cast("binary").alias("value")))
    return alerts.select(F.col("tenant_id").cast("binary").alias("key"), F.to_json(F.struct("*")).cast("binary").alias("value"), header.alias("headers"))


def kafka(servers: str, topic: str) -> Sink:
    """At least once: needs Spark's Kafka connector on the cluster."""
    return lambda batch, number: kafka_rows(batch).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.compression.type", "zstd").option("includeHeaders", "true").save()


def read_kafka(spark, servers: str, topic: str) -> DataFrame:
    """The stream of a topic: ``tenant_id`` from the key and the text."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true").load()
    return raw.select(F.col("key").cast("string").alias("tenant_id"), F.col("value").cast("string").alias("value"), "timestamp")


def route(alerts: DataFrame, sinks: dict[str, Sink], checkpoint: str, late: str = "1 hour"):
    """Writer that gives every batch to all sinks.  An alert id counts once within
    ``late`` of event time ``ts``; a batch that stops between two sinks runs again for
    all of them under its old number."""

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks.values():
                sink(held, number)
        finally:
            held.unpersist()

    once = alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["alert_id"])
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
