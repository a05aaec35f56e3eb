"""Communication-graph analytics over an edge table (src, dst, weight, flows)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.scans import ranked, stored


def build_edges(flows: DataFrame) -> DataFrame:
    x = flows.where("src_ip <> dst_ip").groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"))
    return x.agg(F.sum("total_bytes").alias("weight"), F.count(F.lit(1)).alias("flows"))


def degrees(edges: DataFrame) -> DataFrame:
    o = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0).cast("bigint").alias("iw"))
    i = edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).cast("bigint").alias("ow"), F.col("weight").alias("iw"))
    x = o.unionByName(i).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("ow").alias("out_weight"), F.sum("iw").alias("in_weight"))
    return x.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 30, every: int = 10) -> DataFrame:
    """Fixed rounds; the mass of nodes without outgoing edges is not dealt again.
    Lineage is cut by a reliable checkpoint every few rounds where a checkpoint
    folder is set."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    e = edges.join(out, "src").select("src", "dst", "k").cache()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    cut = edges.sparkSession.sparkContext.getCheckpointDir() is not None or edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    if cut and edges.sparkSession.sparkContext.getCheckpointDir() is None:
        edges.sparkSession.sparkContext.setCheckpointDir(cut)
    for r in range(1, rounds + 1):
        got = e.join(ranks, e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("s"))
        ranks = nodes.join(got, nodes["node"] == got["dst"], "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if cut and r % every == 0:
            ranks = ranks.checkpoint()
    return ranks


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient over out-neighbours: closed / k(k-1).

    Triangles are found once, each from its node of least degree: pairs of neighbours
    are made only among a node's neighbours of greater degree, so a hub makes none.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    pair = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.col("src") < F.col("dst")).alias("ab"), F.max(F.col("src") > F.col("dst")).alias("ba"))
    deg = pair.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    of = lambda c: deg.select(F.col("node").alias(c), F.struct("d", F.col("node").alias("n")).alias(f"_{c}"))
    x = pair.join(of("a"), "a").join(of("b"), "b")
    low = F.col("_a") < F.col("_b")
    # up: from the lower node to the higher one; down: back
    x = x.select(F.when(low, F.col("_a")).otherwise(F.col("_b")).alias("lo"), F.when(low, F.col("_b")).otherwise(F.col("_a")).alias("hi"), F.when(low, F.col("ab")).otherwise(F.col("ba")).alias("up"), F.when(low, F.col("ba")).otherwise(F.col("ab")).alias("down"))
    p = x.select("lo", F.col("hi").alias("p"), F.col("up").alias("lp"), F.col("down").alias("pl"))
    q = x.select("lo", F.col("hi").alias("q"), F.col("up").alias("lq"), F.col("down").alias("ql"))
    closing = x.select(F.col("lo").alias("p"), F.col("hi").alias("q"), F.col("up").alias("pq"), F.col("down").alias("qp"))
    t = p.join(q, "lo").where("p < q").join(closing, ["p", "q"])
    n = lambda c: F.col(c).cast("int")
    corner = lambda node, out1, out2, a, b: F.struct(F.col(f"{node}.n").alias("node"), F.when(F.col(out1) & F.col(out2), n(a) + n(b)).otherwise(0).alias("c"))
    corners = F.explode(F.array(corner("lo", "lp", "lq", "pq", "qp"), corner("p", "pl", "pq", "lq", "ql"), corner("q", "ql", "qp", "lp", "pl"))).alias("x")
    closed = t.select(corners).groupBy(F.col("x.node").alias("src")).agg(F.sum("x.c").alias("c"))
    k = edges.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    y = k.join(closed, "src", "left")
    return y.select(F.col("src").alias("node"), "k", F.when(F.col("k") > 1, F.round(F.coalesce("c", F.lit(0)) / (F.col("k") * (F.col("k") - 1)), 4)).otherwise(0.0).alias("clustering"))


def structural_anomalies(edges: DataFrame, z: float = 3.0, heavy: int = 50_000_000, sent: int = 10_000_000, ratio: float = 20.0) -> DataFrame:
    """Hubs, asymmetric senders and isolated heavy edges."""
    d = degrees(edges)
    stats = d.agg(F.avg("degree").alias("m"), F.stddev_samp("degree").alias("s"))
    hub = d.crossJoin(F.broadcast(stats)).where((F.col("s") > 0) & ((F.col("degree") - F.col("m")) / F.col("s") > z)).select(F.lit("hub_node").alias("kind"), "node", F.lit(None).cast("string").alias("peer"), F.col("degree").cast("double").alias("value"))
    asym = d.where((F.col("out_weight") > sent) & (F.col("in_weight") > 0)).withColumn("value", F.col("out_weight") / F.col("in_weight")).where(F.col("value") > ratio)
    asym = asym.select(F.lit("asymmetric_traffic").alias("kind"), "node", F.lit(None).cast("string").alias("peer"), F.round("value", 2).alias("value"))
    few = d.where("degree <= 3").select(F.col("node").alias("src"))
    iso = edges.where(F.col("weight") > heavy).join(few, "src", "left_semi").select(F.lit("isolated_heavy_edge").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("peer"), F.col("weight").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [hub, asym, iso])


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Communities: each round every node takes its neighbours' most common label
    (of ties the smallest), all at once; stops when nothing changes."""
    near = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct().cache()
    labels = near.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    spark = edges.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    for _ in range(rounds):
        n = near.join(labels, near["b"] == labels["node"]).groupBy("a", "label").agg(F.count(F.lit(1)).alias("c"))
        new = n.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct((-F.col("c")).alias("c"), "label")).alias("label"))
        new = new.checkpoint() if folder else new.cache()
        changed = new.alias("x").join(labels.alias("y"), "node").where("x.label <> y.label").limit(1).count()
        labels = new
        if not changed:
            break
    return labels


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component``: the least node that each node is connected with.  Each
    round takes the least label nearby and then that label's own label, so chains
    shrink by doubling; lineage is cut by a reliable checkpoint."""
    near = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a is not null and b is not null").distinct()
    spark = edges.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    keep = lambda df: df.checkpoint() if folder else df.cache()
    near = keep(near)
    labels = near.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    for _ in range(rounds):
        got = near.join(labels, near["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("c"))
        low = keep(labels.join(got, labels["node"] == got["n"]).select("node", F.col("component").alias("old"), F.least("component", "c").alias("component")))
        up = low.select(F.col("node").alias("n"), F.col("component").alias("c"))
        new = keep(low.join(up, low["component"] == up["n"]).select("node", "old", F.least("component", "c").alias("component")))
        labels = new.select("node", "component")
        if not new.where("old <> component").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges by number in blocks of 512, with the first one's numbers."""
    for b in batches:
        e = np.column_stack([b.column(c).to_numpy().astype(np.int32) for c in ("s", "d")])
        at = range(0, len(e), 512)
        yield pa.RecordBatch.from_arrays([pa.array([int(e[i, 0]) for i in at], pa.int32()), pa.array([int(e[i, 1]) for i in at], pa.int32()), pa.array([e[i : i + 512].tobytes() for i in at], pa.binary())], names=["s", "d", "edges"])


def _through(n: int, groups: int, last: int, most: int = 1 << 26):
    """``no, through``: what shortest paths from a group's share of the nodes below ``last``
    put on each node.  A part gets all edges, which it keeps in a file of its own; so many
    sources are followed at a time that what is known of each of ``n`` nodes stays within
    ``most`` bytes.  A level out or back is one pass over the edges."""

    def sums(file: IO, sizes: list[int], back: bool, rows: np.ndarray, live: np.ndarray) -> np.ndarray:
        """For each node the sum of ``rows`` over the nodes before it; with ``back``, behind it."""
        out, step = np.zeros_like(rows), max(1, most // (32 * rows.shape[1]))
        file.seek(0)
        for m in sizes:
            both = np.fromfile(file, np.int32, 4 * m).reshape(4, m)
            key, other = both[2:] if back else both[1::-1]
            keep = live[other]
            key, other = key[keep], other[keep]
            for i in range(0, len(key), step):
                k = key[i : i + step]
                first = np.flatnonzero(np.diff(k, prepend=-1))
                out[k[first]] += np.add.reduceat(rows[other[i : i + step]], first, axis=0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, sizes, begins = [], [], np.zeros(n, dtype=bool)
        with tempfile.TemporaryFile() as file:
            for b in batches:
                group = b.column("group").to_numpy()
                mine += [g for g in np.unique(group) if g not in mine]
                at = np.flatnonzero(group == mine[0])
                if len(at):
                    e = np.concatenate([np.frombuffer(b.column("edges")[int(i)].as_buffer(), np.int32) for i in at]).reshape(-1, 2)
                    begins[e[:, 0]] = True
                    for c in (1, 0):  # by the end, then by the start
                        e = e[np.argsort(e[:, c], kind="stable")]
                        file.write(np.ascontiguousarray(e.T).tobytes())
                    sizes.append(len(e))
            file.flush()
            total, ids = np.zeros(n), np.flatnonzero(begins[:last])
            ids = np.concatenate([ids[g::groups] for g in mine]) if mine else ids[:0]
            width = max(1, most // (32 * max(n, 1)))
            for i in range(0, len(ids), width):
                start = ids[i : i + width], np.arange(len(ids[i : i + width]))
                paths, level, depth = np.zeros((n, len(start[0]))), np.full((n, len(start[0])), -1, np.int32), 0
                paths[start], level[start] = 1, 0
                while (now := level == depth).any():
                    got = sums(file, sizes, False, np.where(now, paths, 0), now.any(axis=1))
                    new = (level < 0) & (got > 0)
                    depth += 1
                    paths[new], level[new] = got[new], depth
                share = np.zeros_like(paths)
                for k in range(depth - 1, 0, -1):
                    now = level == k
                    got = sums(file, sizes, True, np.divide(1 + share, paths, out=np.zeros_like(paths), where=now), now.any(axis=1))
                    above = level == k - 1
                    share[above] = paths[above] * got[above]
                share[start] = 0
                total += share.sum(axis=1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["no", "through"])

    return run


def betweenness(edges: DataFrame, sources: int | None = None) -> DataFrame:
    """Shortest paths through each node, times 2 / ((n - 1)(n - 2)): from every node to
    every other, or only from the ``sources`` smallest.  Nodes with outgoing edges are
    dealt to the tasks, to each of which all edges go once."""
    spark = edges.sparkSession
    e = stored(edges.where("src <> dst").select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    nodes = stored(ranked(nodes, [], ["node"], "no").withColumn("no", F.col("no") - 1))
    n = nodes.count()
    last = n if sources is None else min(n, sources)
    groups = max(1, min(last, 3 * spark.sparkContext.defaultParallelism))
    of = lambda end, name: nodes.select(F.col("node").alias(end), F.col("no").cast("int").alias(name))
    blocks = stored(e.join(of("src", "s"), "src").join(of("dst", "d"), "dst").select("s", "d").sort("s", "d").mapInArrow(_pairs, "s int, d int, edges binary"))
    dealt = blocks.crossJoin(F.broadcast(spark.range(groups).withColumnRenamed("id", "group"))).repartitionByRange(groups, "group").sortWithinPartitions("group", "s", "d")
    total = dealt.select("group", "edges").mapInArrow(_through(n, groups, last), "no long, through double").groupBy("no").agg(F.sum("through").alias("t"))
    scale = 2.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(total, "no", "left").select("node", F.round(F.coalesce("t", F.lit(0.0)) * scale, 6).alias("betweenness"))


def _inside(c: str):
    return F.regexp_like(F.col(c), F.lit(r"^(10[.]|192[.]168[.]|172[.])"))


def node_roles(edges: DataFrame, between: DataFrame) -> DataFrame:
    """The first role that fits each node's degrees, betweenness and volume."""
    d, one = degrees(edges), edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("only"))
    x = d.join(between, "node", "left").join(one, "node", "left").fillna(0.0, ["betweenness"])
    c, inside = F.col, _inside("node")
    role = F.when(~inside & (c("in_degree") > 5) & (c("out_degree") <= 2), "c2_server").when(inside & (c("out_degree") == 1) & (c("degree") > 5) & ~_inside("only"), "c2_client")
    role = role.when((c("out_degree") > 20) & (c("in_degree") < c("out_degree") * 0.1), "scanner").when((c("betweenness") > 0.1) & (c("degree") > 5), "proxy").when(c("out_weight") > 10_000_000, "data_mover")
    role = role.when((c("in_degree") > 10) & inside, "server").otherwise("workstation")
    return x.select("node", role.alias("role"), "in_degree", "out_degree", "betweenness")


def c2_candidates(edges: DataFrame, ranks: DataFrame, between: DataFrame, beacons: DataFrame, suspicious: DataFrame, least: int = 20) -> DataFrame:
    """External nodes by what speaks for a command server: clients, beacons, rank,
    suspicion (``ip``) and betweenness."""
    x = edges.where(~_inside("dst")).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"), F.count_if(_inside("src")).alias("clients"))
    flag = lambda df, col, name: df.select(F.col(col).alias("node"), F.lit(True).alias(name)).distinct()
    x = x.join(flag(beacons, "dst_ip", "_b"), "node", "left").join(flag(suspicious, "ip", "_s"), "node", "left").join(ranks, "node", "left").join(between, "node", "left")
    add = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    score = add(F.col("clients") > 2, 20) + add(F.col("_b"), 25) + add(F.col("rank") > 0.05, 15) + add(F.col("_s"), 15) + add(F.col("betweenness") > 0.05, 10)
    role = F.when(F.col("in_degree") > 3, "c2_server").when(F.col("betweenness") > 0.05, "redirector").otherwise("staging")
    return x.withColumn("score", score).where(F.col("score") > least).select("node", "clients", "score", role.alias("role"))


def community_profiles(edges: DataFrame, labels: DataFrame, suspicious: DataFrame, least: int = 3) -> DataFrame:
    """Size, density, hub, class and score of each community of ``least`` nodes."""
    d = degrees(edges).join(labels, "node").join(suspicious.select(F.col("ip").alias("node"), F.lit(1).alias("_s")).distinct(), "node", "left")
    hub = F.max_by(F.struct("node", "out_degree", "in_degree"), F.struct("degree", "node"))
    g = d.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("mean_degree"), F.coalesce(F.sum("_s"), F.lit(0)).alias("_s"), hub.alias("hub")).where(F.col("nodes") >= least)
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    e = edges.join(at("src"), "src").join(at("dst"), "dst").where("_src = _dst").groupBy(F.col("_src").alias("label")).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("bytes"), F.sum("flows").alias("flows"))
    c = F.col
    x = g.join(e, "label", "left").fillna(0, ["edges", "bytes", "flows"]).withColumn("density", c("edges") / (c("nodes") * (c("nodes") - 1))).withColumn("odd", c("_s") / c("nodes"))
    star, mesh = (c("hub.out_degree") > c("nodes") * 0.4) & (c("density") < 0.3), (c("density") > 0.5) & (c("nodes") > 4)
    fan, stage = (c("hub.out_degree") > 10) & (c("mean_degree") < 2), (c("bytes") > 50_000_000) & (c("hub.in_degree") > c("nodes") * 0.3)
    kind = F.when(star, "c2_infrastructure").when(mesh, F.when(c("odd") > 0.3, "lateral_movement").otherwise("normal")).when(fan, "scan_network").when(stage, "data_staging").otherwise("normal")
    score = F.when(star, 30).when(mesh, 25).when(fan, 20).when(stage, 25).otherwise(0) + F.when(c("odd") > 0.5, 20).when(c("odd") > 0.2, 10).otherwise(0) + F.when(c("nodes") > 10, 10).otherwise(0)
    return x.select("label", "nodes", "edges", "bytes", "flows", c("hub.node").alias("hub"), F.round("mean_degree", 2).alias("mean_degree"), F.round("density", 4).alias("density"), kind.alias("kind"), F.least(F.lit(100), score).alias("score"))
