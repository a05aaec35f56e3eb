"""Connected components by alternating large-star and small-star rounds.

Only joins and aggregates with partial aggregation: no group is gathered, and a
hub's edges are dealt over ``SALTS`` tasks.  The edges of every round are
written to the shared folder, which cuts the lineage and survives lost
executors.  Self-loops keep their node as a component of its own; an edge with a
null end is ignored; repeated edges and an empty table are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written


#: Copies of a node's least neighbour, so that a hub's edges meet it on several tasks.
SALTS = 8


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges run from the larger node ``a`` to the smaller ``b``.  Large star: each
    node's larger neighbours are linked to its least one.  Small star: each node and
    its smaller neighbours are linked to the least.  A node without a smaller
    neighbour is its own least."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    dealt = least.select(F.col("a").alias("node"), "m", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("part"))
    here, there = ("b", "a") if large else ("a", "b")
    near = edges.withColumn("part", F.pmod(F.xxhash64(there), F.lit(SALTS)).cast("int"))
    linked = near.join(dealt.hint("merge"), (near[here] == dealt["node"]) & (near["part"] == dealt["part"]), "left")
    if large:
        return linked.select("a", F.coalesce("m", "b").alias("b"))
    out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges``; a component's name is its
    least node.  ``max_rounds`` only guards against an endless loop: reaching it
    is an error, never a partial result."""
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    start = written(clean)
    now = written(start.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # equal rows count and hash sum in two rounds: the stars no longer change
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = written(_stars(_stars(now, large=True), large=False))
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = start.select(F.col("a").alias("node")).unionByName(start.select(F.col("b").alias("node"))).distinct()
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
