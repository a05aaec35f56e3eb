"""Lateral movement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import reference as R
from netloom.operators.scans import segments
from netloom.operators.windows import bucketed_range_join, first_by


def internal_flows(flows: DataFrame) -> DataFrame:
    return flows.where(S.is_internal("src_ip") & S.is_internal("dst_ip"))


def detect_scans(flows: DataFrame, least: int = 10) -> DataFrame:
    """Sources with many internal destinations; administration ports among the
    five most used ones raise the score."""
    x = internal_flows(flows)
    wide = x.groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("targets"), F.min("dst_ip").alias("dst_ip")).where(F.col("targets") >= least)
    ports = x.groupBy("src_ip", "dst_port").agg(F.count(F.lit(1)).alias("c"))
    top = ports.withColumn("r", F.row_number().over(W.partitionBy("src_ip").orderBy(F.desc("c"), "dst_port"))).where("r <= 5")
    top = top.groupBy("src_ip").agg(F.count_if(F.col("dst_port").isin(*R.ADMIN_PORTS)).alias("admin_ports"), F.max(F.when(F.col("r") == 1, F.col("dst_port"))).alias("dst_port"))
    score = F.least(F.lit(100), 30 + F.col("targets") * 2 + F.col("admin_ports") * 15)
    return wide.join(top, "src_ip").select("src_ip", "dst_ip", "dst_port", "targets", "admin_ports", score.alias("score"), F.when(F.col("targets") > 20, "HIGH").otherwise("MEDIUM").alias("confidence"), F.when(F.col("admin_ports") > 0, "CRITICAL").otherwise("HIGH").alias("severity"))


def detect_admin_lateral(flows: DataFrame, least: int = 3) -> DataFrame:
    x = internal_flows(flows).join(F.broadcast(R.admin_ports(flows.sparkSession)), "dst_port")
    busy = x.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("src_ip")
    g = x.join(busy, "src_ip", "left_semi").groupBy("src_ip", "dst_port", "service", "technique").agg(F.count_distinct("dst_ip").alias("targets"), F.min("dst_ip").alias("dst_ip")).where("targets >= 2")
    return g.withColumn("score", F.least(F.lit(100), 40 + F.col("targets") * 10)).withColumn("severity", F.when(F.col("targets") > 5, "CRITICAL").otherwise("HIGH"))


def detect_sequential(flows: DataFrame, max_gap: float = 30.0, least: int = 5) -> DataFrame:
    """Chains of new destinations, each within ``max_gap`` of the last accepted
    one; what an accepted row starts depends on the rows before, so rows stream by
    in order.  A pause of more than ``max_gap`` always ends a chain, so a source is
    cut there and its stretches are different tasks' work.  Held at once: the open
    chain's destinations.  Of equal times the lesser id is first; rows without a
    time or source are left out."""

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["src_ip", "dst_ip", "dst_port", "targets", "seconds", "score"]
        now, seen, began, last, port = (None, None), set(), 0.0, 0.0, None
        done = lambda: [(now[0], min(seen), port, len(seen), round(last - began, 3), min(100, 60 + 5 * len(seen)))] if len(seen) >= least else []
        for b in batches:
            out = []
            for s, g, d, p, t in zip(b["src_ip"], b["segment"], b["dst_ip"], b["dst_port"], b["start_time"], strict=True):
                if (s, g) != now or t - last > max_gap:
                    out += done()
                    now, seen, began, last, port = (s, g), {d}, t, t, p
                elif d not in seen:
                    seen.add(d)
                    last = t
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(done(), columns=names)

    x = internal_flows(flows).where("src_ip is not null").select("src_ip", "dst_ip", "dst_port", "start_time", "flow_id")
    by = ["src_ip", "segment"]
    x = segments(x, ["src_ip"], "start_time", max_gap, "flow_id").repartition(*by).sortWithinPartitions(*by, "start_time", "flow_id")
    return x.mapInPandas(chains, "src_ip string, dst_ip string, dst_port int, targets long, seconds double, score long")


def detect_cred_relay(flows: DataFrame, within: float = 10.0) -> DataFrame:
    """Authentication x to y, then y to another host within seconds."""
    auth = internal_flows(flows).where(F.col("dst_port").isin(*R.AUTH_PORTS))
    a = auth.select(F.col("src_ip").alias("origin"), F.col("dst_ip").alias("relay"), F.col("start_time").alias("t"), F.col("flow_id").alias("flow_a"))
    b = auth.select(F.col("src_ip").alias("via"), F.col("dst_ip").alias("target"), F.col("dst_port"), F.col("start_time").alias("u"), F.col("flow_id").alias("flow_b"))
    x = bucketed_range_join(a, b, [("relay", "via")], "t", "u", 0.0, within).where("target <> origin")
    return x.select("origin", "relay", "target", "dst_port", "flow_a", "flow_b", F.round(F.col("u") - F.col("t"), 3).alias("delay"))


def detect_tool_transfer(flows: DataFrame, min_bytes: int = 5_000_000) -> DataFrame:
    x = internal_flows(flows).where((F.col("dst_port") == 445) & (F.col("total_bytes") > min_bytes))
    return first_by(x, ["src_ip", "dst_ip"], ["start_time", "flow_id"]).select("src_ip", "dst_ip", "total_bytes", "flow_id")


def find_pivots(flows: DataFrame) -> DataFrame:
    """Hosts reached from outside that reach two or more internal hosts."""
    inbound = flows.where(~S.is_internal("src_ip") & S.is_internal("dst_ip")).groupBy(F.col("dst_ip").alias("ip")).agg(F.count_distinct("src_ip").alias("sources"))
    out = internal_flows(flows).groupBy(F.col("src_ip").alias("ip")).agg(F.count_distinct("dst_ip").alias("targets"), F.count_distinct(F.when(F.col("dst_port").isin(*R.ADMIN_PORTS), F.col("dst_port"))).alias("admin_ports"), F.count(F.lit(1)).alias("flows"))
    x = inbound.join(out, "ip").where("targets >= 2")
    return x.withColumn("risk_score", F.least(F.lit(100), 20 + F.col("sources") * 10 + F.col("targets") * 8 + F.col("admin_ports") * 12))


def lateral_graph(flows: DataFrame, n: int = 200) -> DataFrame:
    x = internal_flows(flows).groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"), F.bool_or(F.col("dst_port").isin(*R.ADMIN_PORTS)).alias("admin"))
    return x.orderBy(F.desc("flows"), F.desc("bytes"), "src_ip", "dst_ip").limit(n)


