"""Flows and packets stored by day and session, so that a read touches few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.scans import stored

BUCKETS = 64


def _bucket(session: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def _date(seconds: Column, period: str) -> Column:
    day = F.to_date(F.timestamp_seconds(seconds))
    return day if period == "day" else F.trunc(day, period)


def write_by_session(df: DataFrame, path: str, ts: str, session_col: str = "session_id", buckets: int = BUCKETS, mode: str = "append", per_file: int = 5_000_000, period: str = "day", per_task: int = 1_000_000) -> None:
    """Appends rows in folders ``event_date`` (the first day of the ``period``: day, week,
    month or year) / ``session_bucket``.  A day's bucket is one
    task's file unless it is large: rows are dealt by (date, bucket, salt) with as many
    salts as ``per_file`` asks for, sorted by session and time for row-group statistics.
    A task sorts about ``per_task`` rows of one file, however many rows there are.
    Rows without a time go to the day null; without a session to the bucket of null."""
    x = df.withColumn("event_date", _date(F.col(ts), period)).withColumn("session_bucket", _bucket(F.col(session_col), buckets))
    sizes = stored(x.groupBy("event_date", "session_bucket").agg(F.count(F.lit(1)).alias("_n")))
    tasks = 4 * ((sizes.agg(F.sum("_n")).first()[0] or 0) // per_task + 1)
    sizes = sizes.select(F.col("event_date").alias("_d"), F.col("session_bucket").alias("_b"), F.ceil(F.col("_n") / min(per_file, per_task)).alias("_parts"))
    x = x.join(sizes, F.col("event_date").eqNullSafe(F.col("_d")) & (F.col("session_bucket") == F.col("_b")))
    x = x.withColumn("_salt", F.pmod(F.xxhash64(ts), F.col("_parts")))
    x = x.repartition(tasks, "event_date", "session_bucket", "_salt").sortWithinPartitions("event_date", "session_bucket", session_col, ts).drop("_d", "_b", "_parts", "_salt")
    x.write.mode(mode).partitionBy("event_date", "session_bucket").parquet(path)


def read_session(spark: SparkSession, path: str, session_id: str, start: float | None = None, end: float | None = None, ts: str = "start_time", session_col: str = "session_id", buckets: int = BUCKETS, period: str = "day") -> DataFrame:
    """All rows of a session, in ``start <= ts < end`` where given.  Bucket and days are
    constants of the query, so only their folders are read."""
    x = spark.read.parquet(path).where((F.col("session_bucket") == _bucket(F.lit(session_id), buckets)) & (F.col(session_col) == session_id))
    day = lambda t: _date(F.lit(float(t)), period)
    if start is not None:
        x = x.where((F.col("event_date") >= day(start)) & (F.col(ts) >= start))
    if end is not None:
        x = x.where((F.col("event_date") <= day(end)) & (F.col(ts) < end))
    return x.drop("event_date", "session_bucket")
