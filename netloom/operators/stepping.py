"""Stepping stones: two sets of flows whose packets follow each other in time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.scans import in_parts, ranked, running_sums, stored

#: Seconds between a packet and the one that follows it, and packets of a flow or matches of a pair.
MIN_DELAY, MAX_DELAY, MIN_SAMPLES = 0.05, 5.0, 10


def _sequences(packets: DataFrame, key: str, name: str, ts: str, tie: str, least: int) -> DataFrame:
    """Packets of the flows that have enough of them, with their flow's span."""
    x = packets.where(F.col(ts).isNotNull() & (F.col(ts) != 0) & F.col(key).isNotNull()).select(F.col(key).alias(name), F.col(ts).cast("double").alias("timestamp"), F.col(tie).alias("packet_id"))
    spans = x.groupBy(name).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.min("timestamp").alias(f"{name}_from"), F.max("timestamp").alias(f"{name}_to")).where(F.col(f"{name}_n") >= least)
    return x.join(spans, name)


def _gap_ranks(packets: DataFrame, name: str, parts: int | None) -> DataFrame:
    """The gaps between successive times of a flow, numbered from 1; equal times have
    none, so it is the gaps of the distinct times, parts of a flow joined by their ends."""
    times = packets.select(name, "timestamp").distinct()
    x = stored(in_parts(times, [name], ["timestamp"], parts))
    ends = x.groupBy(name, "_part").agg(F.max("timestamp").alias("_to"))
    ends = ends.select(F.col(name).alias("_key"), F.col("_part").alias("_p"), F.lag("_to").over(W.partitionBy(name).orderBy("_part")).alias("_end"))
    x = x.join(ends, (F.col(name) == F.col("_key")) & (F.col("_part") == F.col("_p")))
    before = F.coalesce(F.lag("timestamp").over(W.partitionBy("_part", name).orderBy("_at")), F.col("_end"))
    gaps = x.select(name, "timestamp", (F.col("timestamp") - before).alias(f"{name}_gap")).where(F.col(f"{name}_gap").isNotNull())
    return ranked(gaps, [name], ["timestamp"], "gap_no", parts).select(name, "gap_no", f"{name}_gap")


def candidate_pairs(a: DataFrame, b: DataFrame, lo: float, hi: float, least: int) -> DataFrame:
    """Pairs of flows that overlap in time and have packets of both in steps of ``hi``
    often enough for ``least`` matches.  Steps hold a row a flow, not a packet."""
    step = lambda df, name: df.groupBy(name, F.floor(F.col("timestamp") / hi).alias("step")).agg(F.count(F.lit(1)).alias(f"{name}_c"))
    x = step(a, "in_key").select("in_key", "step", "in_key_c", F.explode(F.array("step", F.col("step") + 1)).alias("at"))
    y = step(b, "out_key").withColumnRenamed("step", "at")
    met = x.join(y, "at").groupBy("in_key", "step", "out_key").agg(F.least(F.max("in_key_c"), F.sum("out_key_c")).alias("most"))
    pairs = met.groupBy("in_key", "out_key").agg(F.sum("most").alias("most")).where(F.col("most") >= least).select("in_key", "out_key")
    spans = lambda df, name: df.select(name, f"{name}_n", f"{name}_from", f"{name}_to").distinct()
    pairs = pairs.join(spans(a, "in_key"), "in_key").join(spans(b, "out_key"), "out_key")
    overlap = F.least("in_key_to", "out_key_to") - F.greatest("in_key_from", "out_key_from")
    return pairs.withColumn("time_window", overlap).where("time_window > 0")


def _step(t: str, hi: float) -> Column:
    """The step of ``hi`` seconds with step * hi <= t < (step + 1) * hi, as doubles compare."""
    at = F.floor(F.col(t) / hi)
    return F.when(F.col(t) < at * hi, at - 1).when(F.col(t) >= (at + 1) * hi, at + 1).otherwise(at)


def _slabs(a: DataFrame, b: DataFrame, hi: float, rows: int, parts: int | None) -> DataFrame:
    """``step, slab, start, end``: runs of steps with about ``rows`` packets.  A slab is
    ``hi`` seconds or more; ``end`` is where the next begins."""
    steps = a.select("timestamp").unionByName(b.select("timestamp")).groupBy(_step("timestamp", hi).alias("step")).agg(F.count(F.lit(1)).alias("c"))
    numbered = stored(running_sums(steps, [], ["step"], parts, _sum=F.col("c")).select("step", F.floor((F.col("_sum") - F.col("c")) / rows).alias("_cut")))
    # few rows: one a slab
    bounds = numbered.groupBy("_cut").agg(F.min("step").alias("_first"), F.max("step").alias("_last"))
    w = W.orderBy("_cut")
    bounds = bounds.select("_cut", F.row_number().over(w).alias("slab"), (F.col("_first") * hi).alias("start"), (F.coalesce(F.lead("_first").over(w), F.col("_last") + 1) * hi).alias("end"))
    return stored(numbered.join(bounds, "_cut").select("step", "slab", "start", "end"))


def _scan(lo: float, hi: float):
    """Matches of a slab's pairs.  Of a pair, ``used`` counts the egress packets from
    ``start + lo`` on that are used or passed.  Each ingress packet takes it to
    min(max(used + 1, below + 1), within): from a start r, after n packets, it is
    min(max(r + n, low), high), less ``passed`` for the next slab."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        start, end, slab = rows["start"].iloc[0], rows["end"].iloc[0], rows["slab"].iloc[0]
        kind = rows["kind"].to_numpy()
        ins, outs, pairs = rows[kind == 0].sort_values(["x", "t"]), rows[kind == 1].sort_values(["y", "t"]), rows[kind == 2].sort_values(["x", "y"])
        name, first, size = np.unique(outs["y"].to_numpy(), return_index=True, return_counts=True)
        times = outs["t"].to_numpy()
        passed = np.array([np.searchsorted(times[f : f + n], end + lo, "left") for f, n in zip(first, size, strict=True)], dtype=np.int64)
        starts = {k: (g["y"].to_numpy(), g["used"].to_numpy()) for k, g in pairs.groupby("x")}
        found = []
        for key, g in ins.groupby("x"):
            if key not in starts:
                continue
            with_, used = starts[key]
            here = np.isin(with_, name)
            with_, used, t = with_[here], used[here].astype(np.int64), g["t"].to_numpy()
            if not len(with_):
                continue
            at = np.searchsorted(name, with_)
            low, high = np.full(len(at), -(1 << 40)), np.full(len(at), 1 << 40)
            n, mean, square = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
            # so many packets at a time that their bounds stay small
            for i in range(0, len(t), max(1, (1 << 20) // len(at))):
                some = t[i : i + max(1, (1 << 20) // len(at))]
                below, within = (np.stack([np.searchsorted(times[first[k] : first[k] + size[k]], some + d, side) for k in at], axis=1) for d, side in ((lo, "left"), (hi, "right")))
                for x, least, most in zip(some, below, within, strict=True):
                    low, high = np.minimum(np.maximum(low, least) + 1, most), np.minimum(np.maximum(high, least) + 1, most)
                    before = np.maximum(used, least)
                    used = np.minimum(before + 1, most)
                    hit = np.flatnonzero(used > before)
                    if len(hit):
                        d = times[first[at[hit]] + used[hit] - 1] - x
                        n[hit] += 1
                        off = d - mean[hit]
                        mean[hit] += off / n[hit]
                        square[hit] += off * (d - mean[hit])
            found.append(pd.DataFrame({"x": key, "y": with_, "packets": len(t), "low": low, "high": high, "passed": passed[at], "n": n.astype(np.int64), "mean": mean, "square": square}))
        out = pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=["x", "y", "packets", "low", "high", "passed", "n", "mean", "square"])
        return out.assign(slab=slab)[["slab", "x", "y", "packets", "low", "high", "passed", "n", "mean", "square"]]

    return run


def match_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame, lo: float, hi: float, rows: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """``x, y, samples, mean, deviation`` of the delays when, for each pair (x of ``a``, y
    of ``b``), every packet of x takes the next unused one of y ``lo`` to ``hi`` later.

    Time is cut into slabs of about ``rows`` packets, each a task with the egress packets
    up to ``hi`` behind it, so a packet is dealt once or twice, not once a pair.  What a
    slab does to a pair's state is three numbers; they are chained over the slabs, and
    only pairs that begin a slab with packets used by the slab before are scanned again.
    """
    slabs = _slabs(a, b, hi, rows, parts)
    bounds = slabs.select("slab", "start", "end").distinct()
    in_slab = lambda df: df.withColumn("step", _step("timestamp", hi)).join(slabs, "step")
    ins = in_slab(a).select("slab", "start", "end", F.lit(0).alias("kind"), "x", F.lit(None).cast("long").alias("y"), F.col("timestamp").alias("t"), F.lit(None).cast("long").alias("used"))
    # an egress packet belongs to its slab and, less than hi behind a slab's start, to the one before
    own = in_slab(b)
    again = own.where(F.col("timestamp") <= F.col("start") + hi).select("y", "timestamp", (F.col("slab") - 1).alias("slab")).join(bounds, "slab")
    outs = own.where(F.col("timestamp") >= F.col("start") + lo).select("slab", "start", "end", "y", "timestamp").unionByName(again.select("slab", "start", "end", "y", "timestamp"))
    outs = outs.select("slab", "start", "end", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("x"), "y", F.col("timestamp").alias("t"), F.lit(None).cast("long").alias("used"))
    dealt = stored(ins.unionByName(outs))
    met = pairs.select("x", "y").join(dealt.where("kind = 0").select("slab", "start", "end", "x").distinct(), "x").join(dealt.where("kind = 1").select("slab", "y").distinct(), ["slab", "y"])
    ask = lambda df, used: df.select("slab", "start", "end", F.lit(2).alias("kind"), "x", "y", F.lit(None).cast("double").alias("t"), used.cast("long").alias("used"))
    schema = "slab int, x long, y long, packets long, low long, high long, passed long, n long, mean double, square double"
    # dealt by slab only: a slab holds a bounded number of packets
    scanned = lambda asked: stored(asked.unionByName(dealt).groupBy("slab").applyInPandas(_scan(lo, hi), schema))
    made = scanned(ask(met, F.lit(0)))
    each = made.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("slab", "packets", "low", "high", "passed"))).alias("ms"))
    zero = F.array(F.struct(F.lit(-1).alias("slab"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("next")))

    def chain(done: Column, m: Column) -> Column:
        last = F.element_at(done, -1)
        used = F.when(last["slab"] + 1 == m["slab"], last["next"]).otherwise(F.lit(0).cast("long"))
        after = F.greatest(F.lit(0).cast("long"), F.least(F.greatest(used + m["packets"], m["low"]), m["high"]) - m["passed"])
        return F.concat(done, F.array(F.struct(m["slab"].alias("slab"), used.alias("used"), after.alias("next"))))

    begun = each.select("x", "y", F.explode(F.aggregate("ms", zero, chain)).alias("s")).select("x", "y", "s.slab", "s.used").where("used > 0")
    begun = stored(begun.join(F.broadcast(bounds), "slab"))
    anew = scanned(ask(begun, F.col("used")))
    kept = made.join(begun.select("slab", "x", "y"), ["slab", "x", "y"], "left_anti").unionByName(anew).where("n > 0")
    c = F.col
    x = kept.groupBy("x", "y").agg(F.sum("n").alias("samples"), F.sum(c("n") * c("mean")).alias("_s"), F.sum(c("square") + c("n") * c("mean") * c("mean")).alias("_q"))
    mean = c("_s") / c("samples")
    spread = F.when(c("samples") > 1, F.sqrt(F.greatest(F.lit(0.0), c("_q") - c("_s") * mean) / (c("samples") - 1))).otherwise(0.0)
    return x.select("x", "y", "samples", mean.alias("mean"), spread.alias("deviation"))


def _moments(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block of gap numbers, each pair's count, sums and products over the numbers
    that both flows have."""
    kind, first = rows["kind"].to_numpy(), int(rows["block"].iloc[0])
    width = int(rows["no"].max()) + 1 if (kind < 2).any() else 1

    def table(df: pd.DataFrame, key: str):
        name, at = np.unique(df[key].to_numpy(), return_inverse=True)
        gap, has = np.zeros((len(name), width)), np.zeros((len(name), width))
        gap[at, df["no"].to_numpy(dtype=int)], has[at, df["no"].to_numpy(dtype=int)] = df["gap"].to_numpy(), 1.0
        return name, gap, has

    (xs, a, has_a), (ys, b, has_b) = table(rows[kind == 0], "x"), table(rows[kind == 1], "y")
    found = []
    for key, g in rows[kind == 2].groupby("x"):
        i, y = np.searchsorted(xs, key), g["y"].to_numpy()
        y = y[np.isin(y, ys)]
        if i == len(xs) or xs[i] != key or not len(y):
            continue
        for j in range(0, len(y), 256):
            some = y[j : j + 256]
            k = np.searchsorted(ys, some)
            p, q, both = a[i], b[k], has_b[k] * has_a[i]
            found.append(pd.DataFrame({"x": key, "y": some, "n": both.sum(axis=1), "sx": both @ p, "sy": (both * q).sum(axis=1), "sxx": both @ (p * p), "syy": (both * q * q).sum(axis=1), "sxy": (both * q) @ p}))
    names = ["x", "y", "n", "sx", "sy", "sxx", "syy", "sxy"]
    return (pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=names)).assign(block=first)[["block", *names]]


def gap_correlations(a: DataFrame, b: DataFrame, pairs: DataFrame, block: int = 512) -> DataFrame:
    """``x, y, _n, _r``: correlation of the k-th gaps of the two flows of a pair, from
    sums over blocks of gap numbers; no row a pair and gap is made.  Gaps are taken
    from their flow's median, so even ones sum to nothing."""

    def dealt(df: DataFrame, key: str, kind: int) -> DataFrame:
        mid = df.groupBy(key).agg(F.median("gap").alias("_mid"))
        x = df.join(mid, key).select(key, F.floor((F.col("gap_no") - 1) / block).alias("block"), ((F.col("gap_no") - 1) % block).alias("no"), (F.col("gap") - F.col("_mid")).alias("gap"))
        other = "y" if key == "x" else "x"
        return x.withColumn(other, F.lit(None).cast("long")).select(F.lit(kind).alias("kind"), "block", "x", "y", "no", "gap")

    x, y = stored(dealt(a.join(pairs.select("x").distinct(), "x"), "x", 0)), stored(dealt(b.join(pairs.select("y").distinct(), "y"), "y", 1))
    asked = pairs.select("x", "y").join(x.select("x", "block").distinct(), "x").join(y.select("y", "block").distinct(), ["y", "block"])
    asked = asked.select(F.lit(2).alias("kind"), "block", "x", "y", F.lit(None).cast("long").alias("no"), F.lit(None).cast("double").alias("gap"))
    # a block's flows are dealt by those of one side, so many flows are many tasks
    deal = 64
    share = lambda df: df.withColumn("deal", F.pmod(F.xxhash64("x"), F.lit(deal)).cast("int"))
    rows = reduce(DataFrame.unionByName, [share(x), share(asked), y.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))])
    made = rows.groupBy("block", "deal").applyInPandas(_moments, "block long, x long, y long, n double, sx double, sy double, sxx double, syy double, sxy double")
    t = made.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    c = F.col
    spread = lambda v: F.when(c("n") * c(f"s{v}{v}") - c(f"s{v}") * c(f"s{v}") > 1e-12 * c("n") * c(f"s{v}{v}"), c("n") * c(f"s{v}{v}") - c(f"s{v}") * c(f"s{v}"))
    return t.select("x", "y", c("n").alias("_n"), ((c("n") * c("sxy") - c("sx") * c("sy")) / (F.sqrt(spread("x")) * F.sqrt(spread("y")))).alias("_r"))


def correlate_timing(ingress: DataFrame, egress: DataFrame, in_key: str = "flow_id", out_key: str = "flow_id", ts: str = "timestamp", tie: str = "packet_id", lo: float = MIN_DELAY, hi: float = MAX_DELAY, least: int = MIN_SAMPLES, cut: float = 0.3, parts: int | None = None, rows: int = 1 << 16) -> DataFrame:
    """Pairs of flows of two sets of packets that go together: each packet of ``ingress``
    is matched with the next unused one of ``egress`` ``lo`` to ``hi`` seconds later.

    Score: 0.3 for the share of packets matched (half counts as all), 0.3 for even
    delays (1 - deviation / mean) and 0.4 for the correlation of the two flows' gaps.
    Flows of fewer than ``least`` packets and pairs of fewer matches are left out.
    """
    a, b = stored(_sequences(ingress, in_key, "in_key", ts, tie, least)), stored(_sequences(egress, out_key, "out_key", ts, tie, least))
    pairs = stored(candidate_pairs(a, b, lo, hi, least))
    keys = ["in_key", "out_key"]
    # flows by number, since tasks hold many
    numbered = lambda name, to: stored(pairs.select(name).distinct().withColumn(to, F.monotonically_increasing_id()))
    xs, ys = numbered("in_key", "x"), numbered("out_key", "y")
    both = stored(pairs.join(xs, "in_key").join(ys, "out_key"))
    delays = match_pairs(a.join(xs, "in_key").select("x", "timestamp"), b.join(ys, "out_key").select("y", "timestamp"), both, lo, hi, rows, parts).where(F.col("samples") >= least)
    used = stored(both.join(delays, ["x", "y"]))
    ranks = lambda df, name, of, to: _gap_ranks(df, name, parts).join(of, name).select(to, "gap_no", F.col(f"{name}_gap").alias("gap"))
    alike = gap_correlations(ranks(a, "in_key", xs, "x"), ranks(b, "out_key", ys, "y"), used)
    r = F.when(F.col("_n") >= 5, F.round("_r", 4))
    x = used.join(alike, ["x", "y"], "left").withColumn("gap_correlation", F.coalesce(r, F.lit(0.0)))
    c = F.col
    share = F.least(F.lit(1.0), c("samples") / (c("in_key_n") * 0.5))
    even = F.greatest(F.lit(0.0), 1 - F.when(c("mean") > 0, c("deviation") / c("mean")).otherwise(1.0))
    x = x.withColumn("_score", 0.3 * share + 0.3 * even + 0.4 * F.greatest(F.lit(0.0), c("gap_correlation"))).where(c("_score") >= cut)
    level = F.when(c("_score") > 0.8, "CRITICAL").when(c("_score") > 0.6, "HIGH").when(c("_score") > 0.4, "MEDIUM").otherwise("LOW")
    return x.select(*keys, "samples", F.round("mean", 4).alias("delay_mean"), F.round("deviation", 4).alias("delay_deviation"), "gap_correlation", F.round("_score", 4).alias("score"), level.alias("confidence"), F.round("time_window", 3).alias("time_window"))
