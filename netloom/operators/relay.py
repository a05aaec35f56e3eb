"""Traffic with known relay nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import scalar as S
from netloom.operators import reference as R
from netloom.operators.scans import stored
from netloom.operators.windows import gaps


def match_relay_nodes(flows: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Flows with a relay at either end; the destination counts first."""
    # a table given as argument is broadcast only if Spark finds it small enough
    given = F.broadcast if nodes is None else lambda df: df
    nodes = R.relay_nodes(flows.sparkSession) if nodes is None else nodes
    of = lambda end: nodes.groupBy(F.col("ip").alias(f"{end}_ip")).agg(F.struct(F.first("ip").alias("ip"), F.min("node_type").alias("node_type")).alias(f"_{end}"))
    # looked up at either end, so flows are not dealt where nodes are few
    x = flows.join(given(of("dst")), "dst_ip", "left").join(given(of("src")), "src_ip", "left").withColumn("h", F.coalesce("_dst", "_src"))
    return x.where("h is not null").select("flow_id", "src_ip", "dst_ip", F.col("h.ip").alias("relay_ip"), F.col("h.node_type").alias("node_type"))


def cell_ratios(packets: DataFrame, cell: int = 541, tolerance: int = 30, least: int = 20, cut: float = 0.55) -> DataFrame:
    """Pairs most of whose packets have the size of relay cells."""
    x = packets.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("packets"), F.round(F.avg(S.is_cell_size("size", cell, tolerance).cast("double")), 4).alias("cell_ratio"))
    return x.where((F.col("packets") >= least) & (F.col("cell_ratio") > cut))


def relay_persistence(flows: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """How often each client uses each relay, and its share of the client's use."""
    m = match_relay_nodes(flows, nodes).groupBy("src_ip", "relay_ip").agg(F.count(F.lit(1)).alias("uses"))
    t = m.groupBy("src_ip").agg(F.sum("uses").alias("total"), F.count(F.lit(1)).alias("relays"))
    return m.join(t, "src_ip").select("src_ip", "relay_ip", "uses", "relays", F.round(F.col("uses") / F.col("total"), 4).alias("share"))


def relay_c2(flows: DataFrame, nodes: DataFrame | None = None, least: int = 5, least_gaps: int = 4, max_cv: float = 0.35, max_gap: float = 7200.0) -> DataFrame:
    """Clients that call a relay at steady intervals."""
    m = match_relay_nodes(flows, nodes).select("flow_id", "relay_ip").join(flows.select("flow_id", "src_ip", "start_time"), "flow_id")
    n = m.groupBy("src_ip", "relay_ip").agg(F.count(F.lit(1)).alias("flows")).where(F.col("flows") >= least)
    g = gaps(m, ["src_ip", "relay_ip"], "start_time", 0.0, "flow_id").where(F.col("gap") < max_gap)
    g = g.groupBy("src_ip", "relay_ip").agg(F.count(F.lit(1)).alias("k"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s")).where((F.col("k") >= least_gaps) & (F.col("m") > 10))
    return n.join(g, ["src_ip", "relay_ip"]).withColumn("cv", F.round(F.col("s") / F.col("m"), 4)).where(F.col("cv") < max_cv).select("src_ip", "relay_ip", "flows", "cv")


def relay_client_fingerprints(flows: DataFrame, nodes: DataFrame | None = None, clients: DataFrame | None = None, ciphers=R.RELAY_CLIENT_CIPHERS, ports=(9001, 9030, 9040, 9050, 9051, 9150, 443, 80), least: int = 4) -> DataFrame:
    """Signs of relay clients: a known fingerprint (once a source and fingerprint), only
    ciphers that such clients offer, ``least`` at least (once a source), TLS without a
    name to a relay (once a pair), and any flow to a directory authority.  The earliest
    flow stands for its group; ``flows`` may lack ``cipher_suites``."""
    spark = flows.sparkSession
    nodes = R.relay_nodes(spark) if nodes is None else nodes
    clients = R.relay_client_ja3(spark) if clients is None else clients
    of = nodes.groupBy(F.col("ip").alias("dst_ip")).agg(F.max(F.col("node_type") == "authority").alias("authority"))
    ends = ("flow_id", "src_ip", "dst_ip", "dst_port", "start_time")
    # read by every sign, so written once
    flows = stored(flows.select(*ends, "protocol", "sni", "ja3", *[c for c in ("cipher_suites",) if c in flows.columns]))
    first = F.min_by(F.struct(*ends), F.struct("start_time", "flow_id")).alias("f")

    def sign(x: DataFrame, keys: list[str], kind: str, detail, confidence: float, severity: str, score: int) -> DataFrame:
        # the earliest time first: rows of a map's task aren't sorted by key with all their columns
        x = x.withColumn("detail", detail).withColumn("_t", F.coalesce("start_time", F.lit(float("-inf"))))
        at = stored(x.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min("_t").alias("_of_t")))
        x = x.join(at, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_t") == F.col("_of_t")))
        y = x.groupBy(*keys).agg(first, F.min_by("detail", F.struct("start_time", "flow_id")).alias("detail"))
        return y.select(F.lit(kind).alias("kind"), *[F.col(f"f.{c}").alias(c) for c in ends], "detail", F.lit(confidence).alias("confidence"), F.lit(severity).alias("severity"), F.lit(score).alias("score"))

    known = sign(flows.join(clients, "ja3"), ["src_ip", "ja3"], "ja3_match", F.col("client"), 0.95, "HIGH", 88)
    bare = flows.where("protocol = 'TLS' and coalesce(sni, '') = ''").where(F.col("dst_port").isin(*ports)).join(of.select("dst_ip"), "dst_ip")
    unnamed = sign(bare, ["src_ip", "dst_ip"], "nosni_relay_port", F.col("dst_port").cast("string"), 0.8, "HIGH", 72)
    directory = sign(flows.join(of.where("authority").select("dst_ip"), "dst_ip"), ["flow_id"], "directory", F.col("protocol"), 0.9, "CRITICAL", 80)
    out = known.unionByName(unnamed).unionByName(directory)
    if "cipher_suites" in flows.columns:
        offered = F.array_distinct("cipher_suites")
        only = flows.where((F.size(offered) >= least) & (F.size(F.array_except("cipher_suites", F.array(*[F.lit(c) for c in ciphers]))) == 0))
        out = out.unionByName(sign(only, ["src_ip"], "cipher_match", F.size(offered).cast("string"), 0.7, "MEDIUM", 62))
    return out
