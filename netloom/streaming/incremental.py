"""Flows, beacons and endpoint profiles kept up to date from new packets only.

Packets are filed by flow and time step.  For each (flow, step) a partial state is kept:
number and bytes of packets, first and last one, and the number, mean and squared
deviation of the gaps inside the step.  A batch reads its own packets and the states of
the steps that it touches.  Packets behind a state's last one extend it; where some came
late, that (flow, step) alone is made anew from its stored packets.  Gaps between steps
come from their ends, so flows and beacons so far are an aggregate of states, never of
packets.

States are written per batch, the latest of a (flow, step) counts, and a batch reads
only what earlier ones wrote: a batch that runs again after a stop leaves the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators import traffic

_PACKET = "flow_id string, packet_id long, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size long, step long, batch long"
_END = "struct<timestamp: double, packet_id: long, src_ip: string, dst_ip: string, src_port: int, dst_port: int, protocol: string>"
_STATE = f"flow_id string, packets long, bytes long, first {_END}, last struct<timestamp: double, packet_id: long>, gaps long, mean double, squares double, step long, batch long"
_KEYS = ["flow_id", "step"]
_COLUMNS = ("packets", "bytes", "first", "last", "gaps", "mean", "squares")


def _states(packets: DataFrame, min_gap: float) -> DataFrame:
    """State of each (flow, step) of these packets alone."""
    w = W.partitionBy(*_KEYS).orderBy("timestamp", "packet_id")
    gap = F.col("timestamp") - F.lag("timestamp").over(w)
    x = packets.withColumn("gap", F.when(gap > min_gap, gap))
    end = F.struct("timestamp", "packet_id")
    return x.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.min(F.struct("timestamp", "packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")).alias("first"), F.max(end).alias("last"),
        F.count("gap").alias("gaps"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("gap") * F.count("gap"), F.lit(0.0)).alias("squares"),
    )


def _joined(a, b):
    """Number, mean and squared deviation of two sets of gaps together."""
    n = a[0] + b[0]
    mean = F.when(n > 0, (a[0] * a[1] + b[0] * b[1]) / n).otherwise(0.0)
    return n, mean, a[2] + b[2] + F.when(n > 0, a[0] * b[0] / n * (a[1] - b[1]) * (a[1] - b[1])).otherwise(0.0)


class Incremental:
    """The analysis in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, width: float = 3600.0, min_gap: float = 0.05):
        self.spark, self.folder, self.width, self.min_gap = spark, folder.rstrip("/"), width, min_gap
        for name, schema in (("packets", _PACKET), ("states", _STATE)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_PACKET if name == "packets" else _STATE).parquet(f"{self.folder}/{name}")

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step", "batch").parquet(f"{self.folder}/{name}")

    def _latest(self, states: DataFrame) -> DataFrame:
        x = states.groupBy(*_KEYS).agg(F.max_by(F.struct(*_COLUMNS), "batch").alias("s"))
        return x.select(*_KEYS, *[f"s.{c}" for c in _COLUMNS])

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch of packets; ``number`` grows from batch to batch."""
        step = F.floor(F.col("timestamp") / self.width)
        p = traffic.with_flow_id(batch.where("timestamp is not null")).withColumn("step", step).withColumn("batch", F.lit(number).cast("long"))
        names = [c.strip().split()[0] for c in _PACKET.split(",")]
        self._put(p.select(*[F.col(n).cast(dict(zip(names, [c.strip().split()[1] for c in _PACKET.split(",")], strict=True))[n]).alias(n) for n in names]), "packets")
        mine = self._read("packets").where(F.col("batch") == number)
        low, high = mine.agg(F.min("step"), F.max("step")).first()
        if low is None:
            return
        near = F.col("step").between(low, high)
        old = self._latest(self._read("states").where(near & (F.col("batch") < number)))
        old = old.select(*_KEYS, *[F.col(c).alias(f"old_{c}") for c in _COLUMNS])
        x = _states(mine, self.min_gap).join(old, _KEYS, "left")
        fresh = F.col("old_last").isNull()
        behind = F.struct("first.timestamp", "first.packet_id") > F.col("old_last")
        link = F.col("first.timestamp") - F.col("old_last.timestamp")
        linked = (F.when(link > self.min_gap, 1).otherwise(0), link, F.lit(0.0))
        n, mean, squares = _joined(_joined([F.col(f"old_{c}") for c in ("gaps", "mean", "squares")], linked), [F.col(c) for c in ("gaps", "mean", "squares")])
        extended = x.where(~fresh & behind).select(
            *_KEYS, (F.col("packets") + F.col("old_packets")).alias("packets"), (F.col("bytes") + F.col("old_bytes")).alias("bytes"), F.col("old_first").alias("first"), "last",
            n.alias("gaps"), mean.alias("mean"), squares.alias("squares"),
        )
        late = x.where(~fresh & ~behind).select(*_KEYS)
        again = _states(self._read("packets").where(near & (F.col("batch") <= number)).join(late, _KEYS, "left_semi"), self.min_gap)
        out = x.where(fresh).select(*_KEYS, *_COLUMNS).unionByName(extended).unionByName(again)
        self._put(out.withColumn("batch", F.lit(number).cast("long")), "states")

    def start(self, packets: DataFrame, checkpoint: str):
        """Writer that adds every batch of a streaming table of packets."""
        return packets.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)

    def _flows(self) -> DataFrame:
        x = self._latest(self._read("states"))
        gap = F.col("first.timestamp") - F.lag("last.timestamp").over(W.partitionBy("flow_id").orderBy("step"))
        x = x.withColumn("between", F.when(gap > self.min_gap, gap))
        sums = x.groupBy("flow_id").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("packets").alias("packet_count"), F.sum("bytes").alias("total_bytes"),
            (F.sum("gaps") + F.count("between")).alias("k"), (F.sum(F.col("gaps") * F.col("mean")) + F.coalesce(F.sum("between"), F.lit(0.0))).alias("total"),
        )
        m = F.when(F.col("k") > 0, F.col("total") / F.col("k")).otherwise(0.0)
        off = x.join(sums.select("flow_id", m.alias("m")), "flow_id").groupBy("flow_id").agg(
            (F.sum(F.col("squares") + F.col("gaps") * F.pow(F.col("mean") - F.col("m"), 2)) + F.coalesce(F.sum(F.pow(F.col("between") - F.col("m"), 2)), F.lit(0.0))).alias("off"), F.first("m").alias("m")
        )
        return sums.join(off, "flow_id").withColumn("s", F.when(F.col("k") > 1, F.sqrt(F.col("off") / (F.col("k") - 1))))

    def flows(self) -> DataFrame:
        """All flows so far, as ``traffic.aggregate_flows`` has them."""
        ends = [F.col(f"first.{c}").alias(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]
        x = self._flows().select("flow_id", *ends, F.col("first.timestamp").alias("start_time"), F.col("last.timestamp").alias("end_time"), "packet_count", "total_bytes")
        return x.withColumn("session_duration", F.col("end_time") - F.col("start_time")).withColumn("avg_packet_size", F.col("total_bytes") / F.col("packet_count"))

    def beacons(self, min_points: int = 5) -> DataFrame:
        """Beacons so far, as ``traffic.detect_beacons`` has them."""
        x = self._flows().where((F.col("packet_count") >= min_points) & (F.col("k") >= 3))
        x = x.withColumn("cv", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(1.0))
        return traffic.beacon_rows(x.select("flow_id", "first.src_ip", "first.dst_ip", "first.dst_port", "packet_count", "m", "s", "cv"))

    def profiles(self) -> DataFrame:
        """Endpoint profiles over all flows so far; packets carry no fingerprints."""
        flows = self.flows().withColumn("ja3", F.lit(None).cast("string")).withColumn("sni", F.lit(None).cast("string"))
        return traffic.profile_endpoints(flows, beacons=self.beacons())
