"""Baselines and robust outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators.scans import running_sums
from netloom.operators.windows import group_entropy, median_mad

FEATURES = ("total_bytes", "packet_count", "session_duration", "unique_destinations", "port_entropy", "tls_ratio")


def build_baseline(flows: DataFrame, least: int = 5) -> DataFrame:
    """Usual behaviour of each source with at least ``least`` flows."""
    x = flows.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("flows"), F.count_distinct("dst_ip").alias("destinations"), F.median("session_duration").alias("median_duration"), F.round(F.avg((F.col("protocol") == "TLS").cast("double")), 4).alias("tls_ratio")
    )
    mad = median_mad(flows, ["src_ip"], "total_bytes").withColumnsRenamed({"median": "median_bytes", "mad": "mad_bytes"})
    n = flows.groupBy("src_ip", "dst_port").agg(F.count(F.lit(1)).alias("c"))
    top = n.withColumn("r", F.row_number().over(W.partitionBy("src_ip").orderBy(F.desc("c"), "dst_port"))).where("r <= 10")
    ports = top.groupBy("src_ip").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "dst_port"))), lambda s: s["dst_port"].cast("string")), ",").alias("top_ports"))
    return x.where(F.col("flows") >= least).join(mad, "src_ip").join(ports, "src_ip")


def destination_growth(flows: DataFrame, positions: int = 10, parts: int | None = None) -> DataFrame:
    """How many distinct destinations each source had met at about ``positions`` evenly
    spaced flows: ``src_ip, position`` (flows before it)``, destinations``.  A pair's
    first flow counts one; the counts are running sums over parts of the order, so a
    source with half of all flows is many tasks."""
    x = flows.where("src_ip is not null and start_time is not null").select("src_ip", "dst_ip", "start_time", "flow_id")
    order = F.struct("start_time", "flow_id")
    first = x.groupBy("src_ip", "dst_ip").agg(F.min(order).alias("_f")).select("src_ip", "_f.start_time", "_f.flow_id", F.lit(1).alias("_new"))
    marked = x.join(first, ["src_ip", "start_time", "flow_id"], "left")
    run = running_sums(marked, ["src_ip"], ["start_time", "flow_id"], parts, _no=F.lit(1).cast("long"), destinations=F.coalesce("_new", F.lit(0)).cast("long"))
    n = x.groupBy("src_ip").agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / positions))
    return run.join(n, "src_ip").withColumn("position", F.col("_no") - 1).where(F.col("position") % step == 0).select("src_ip", "position", "destinations")


def destination_spread(flows: DataFrame, least: int = 3) -> DataFrame:
    """Median absolute deviation of each source's counts in ``destination_growth``."""
    g = destination_growth(flows)
    enough = g.groupBy("src_ip").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("src_ip")
    return median_mad(g.join(enough, "src_ip"), ["src_ip"], "destinations").select("src_ip", F.col("mad").alias("mad_destinations"))


def usual_values(history: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` commonest values of each source; of equal counts the least value."""
    counts = history.where(F.col(value).isNotNull()).groupBy("src_ip", value).agg(F.count(F.lit(1)).alias("c"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy("src_ip").orderBy(F.desc("c"), value))).where(F.col("r") <= n).select("src_ip", value)


def detect_deviations(current: DataFrame, history: DataFrame, least: int = 5, new_least: int = 20) -> DataFrame:
    """``src_ip, kind, value, usual, risk, severity``: how sources differ from their
    ``history`` (``least`` flows or more): no history but many flows, volume, and
    destinations, hours and ports that are not among the usual ones.  Flows without
    a source are left out, as are null values."""
    current, history = (f.where("src_ip <> ''").withColumn("hour", (F.floor(F.col("start_time") / 3600) % 24).cast("int")) for f in (current, history))
    base = history.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("src_ip")
    now = current.groupBy("src_ip").agg(F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"))
    c = F.col

    def rows(x: DataFrame, kind: str, value, usual, risk, severity="MEDIUM") -> DataFrame:
        return x.select("src_ip", F.lit(kind).alias("kind"), value.cast("double").alias("value"), usual.cast("double").alias("usual"), F.round(risk.cast("double"), 2).alias("risk"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))

    out = [rows(now.join(base, "src_ip", "left_anti").where(c("flows") > new_least), "new_endpoint", c("flows"), F.lit(0), F.lit(40))]
    x = now.join(base, "src_ip").join(median_mad(history, ["src_ip"], "total_bytes"), "src_ip").withColumn("z", F.abs(S.modified_z("bytes", "median", "mad"))).where("z > 3")
    out.append(rows(x, "byte_spike", c("bytes"), c("median"), F.least(F.lit(100), 35 + c("z") * 8), F.when(c("z") > 5, "HIGH").otherwise("MEDIUM")))
    # How many usual values are kept, and how risk grows with new ones.
    for kind, value, n, start, step, most in (("new_destinations", "dst_ip", 10, 30, 3, 80), ("unusual_hours", "hour", 8, 25, 8, 60), ("new_ports", "dst_port", 10, 20, 4, 50)):
        known = usual_values(history, value, n).join(base, "src_ip", "left_semi")
        size = known.groupBy("src_ip").agg(F.count(F.lit(1)).alias("known"))
        new = current.where(c(value).isNotNull()).select("src_ip", value).distinct().join(known, ["src_ip", value], "left_anti").groupBy("src_ip").agg(F.count(F.lit(1)).alias("new")).join(size, "src_ip")
        enough = {"new_destinations": (c("new") > 5) & (c("new") > 0.5 * c("known")), "unusual_hours": c("new") > 0, "new_ports": c("new") > 3}[kind]
        out.append(rows(new.where(enough), kind, c("new"), c("known"), F.least(F.lit(most), start + step * c("new"))))
    return reduce(DataFrame.unionByName, out)


def source_features(flows: DataFrame) -> DataFrame:
    x = flows.groupBy("src_ip").agg(
        F.sum("total_bytes").cast("double").alias("total_bytes"), F.sum("packet_count").cast("double").alias("packet_count"), F.avg("session_duration").alias("session_duration"),
        F.count_distinct("dst_ip").cast("double").alias("unique_destinations"), F.avg((F.col("protocol") == "TLS").cast("double")).alias("tls_ratio"),
    )
    return x.join(group_entropy(flows, ["src_ip"], "dst_port", "port_entropy"), "src_ip")


def hunt_outliers(flows: DataFrame, least_sources: int = 5, cut: float = 3.0, floor: float = 0.001) -> DataFrame:
    """Sources whose robust z-scores over six features have a root mean square
    over ``cut``.  Medians are one row, broadcast."""
    x = source_features(flows)
    mid = x.agg(*[F.median(f).alias(f"{f}_m") for f in FEATURES], F.count(F.lit(1)).alias("n_sources"))
    y = x.crossJoin(F.broadcast(mid)).where(F.col("n_sources") >= least_sources)
    mad = y.agg(*[F.greatest(F.median(F.abs(F.col(f) - F.col(f"{f}_m"))), F.lit(floor)).alias(f"{f}_d") for f in FEATURES])
    z = [0.6745 * (F.col(f) - F.col(f"{f}_m")) / F.col(f"{f}_d") for f in FEATURES]
    score = F.sqrt(sum((v * v for v in z), F.lit(0.0)) / len(FEATURES))
    out = y.crossJoin(F.broadcast(mad)).withColumn("score", score).where(F.col("score") > cut)
    odd = F.array_join(F.array_compact(F.array(*[F.when(F.abs(v) > 2.5, F.lit(f)) for f, v in zip(FEATURES, z, strict=True)])), ",")
    return out.select("src_ip", F.round("score", 2).alias("score"), odd.alias("features"), F.when(F.col("score") > 6, "CRITICAL").when(F.col("score") > 4.5, "HIGH").when(F.col("score") > 3.5, "MEDIUM").otherwise("LOW").alias("severity"))


def peer_outliers(flows: DataFrame, least_peers: int = 3) -> DataFrame:
    """Hosts whose volume stands out from the other hosts of their /24."""
    x = flows.groupBy("src_ip").agg(F.sum("total_bytes").alias("bytes"), F.count_distinct("dst_ip").alias("destinations")).withColumn("subnet", S.prefix24("src_ip"))
    m = median_mad(x, ["subnet"], "bytes").join(x.groupBy("subnet").agg(F.count(F.lit(1)).alias("peers")), "subnet")
    y = x.join(m, "subnet").where((F.col("peers") >= least_peers) & (F.col("mad") > 0)).withColumn("z", S.modified_z("bytes", "median", "mad"))
    return y.where("abs(z) > 3").select("src_ip", "subnet", "peers", "bytes", "z")


def hunt_temporal(flows: DataFrame, least: int = 10) -> DataFrame:
    """Sources busy off hours (00-05 UTC) or in a single hour."""
    n = flows.groupBy("src_ip", S.hour_of("start_time").alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    x = n.groupBy("src_ip").agg(F.sum("c").alias("flows"), F.sum(F.when(F.col("hour") <= 5, F.col("c")).otherwise(0)).alias("off"), F.max("c").alias("top"), F.max_by("hour", F.struct("c", (-F.col("hour")).alias("h"))).alias("top_hour"))
    x = x.where(F.col("flows") >= least).withColumn("off_ratio", F.round(F.col("off") / F.col("flows"), 4)).withColumn("top_ratio", F.round(F.col("top") / F.col("flows"), 4))
    return x.where("off_ratio > 0.4 or top_ratio > 0.5").select("src_ip", "flows", "off_ratio", "top_hour", "top_ratio")
