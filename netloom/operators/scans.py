"""Scans over ordered rows whose result at a row depends on the rows before it.

A key's rows are dealt by range over (key, order), so that a key with a third of all
rows is many tasks.  Each part is scanned on its own to a small summary for each key;
the summaries of a key, one a part, are combined in order; what they give at a part's
start is joined back.  Nothing holds a whole key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark) -> str:
    """A new folder that the driver and all executors reach: below
    ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/scan-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its rows, and what
    partitions they were in, no longer change when a task is run again."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` dealt by range and sorted, with columns ``_part`` and ``_at`` (the place
    in the whole order).  Rows of equal keys and order stay in one part."""
    x = df.repartitionByRange(*([parts] if parts else []), *keys, *order).sortWithinPartitions(*keys, *order)
    return x.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"_of_{k}"])
    return on


def _with_start(x: DataFrame, starts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Joins what a key has at each part's start."""
    on = ["_part", *keys]
    y = starts.select(*[F.col(k).alias(f"_of_{k}") for k in on], *names)
    return x.join(y, _same(x, y, on), "left").drop(*[f"_of_{k}" for k in on])


def running_sums(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None, **values: Column) -> DataFrame:
    """Running sums within a key, the row's own value included."""
    x = stored(in_parts(df.withColumns({f"_v_{n}": v for n, v in values.items()}), keys, order, parts))
    w = W.partitionBy("_part", *keys).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    sums = x.groupBy("_part", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_part", *keys, *[F.sum(f"_t_{n}").over(before).alias(f"_s_{n}") for n in values])
    x = _with_start(x.withColumns({n: F.sum(f"_v_{n}").over(w) for n in values}), starts, keys, [f"_s_{n}" for n in values])
    return x.withColumns({n: F.col(n) + F.coalesce(F.col(f"_s_{n}"), F.lit(0)) for n in values}).drop("_part", "_at", *[f"_{a}_{n}" for n in values for a in "vs"])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Row number from 1 within a key, without a window over the whole key."""
    return running_sums(df, keys, order, parts, **{name: F.lit(1).cast("long")})


def ranked_by_hash(df: DataFrame, keys: list[str], hashed: Column, tie: str, name: str = "rank", keep: list[str] | None = None) -> DataFrame:
    """Row number from 1 within a key, in the order of a hash in hex digits and ``tie``.

    Rows that agree in the hash's first three digits are numbered on their own and then
    written, once and with no more than ``keys`` and ``keep`` of their columns; what the
    4096 groups before hold is joined back.  A hash is even, so nothing is sampled to
    deal the rows and no key is ordered in one task.
    """
    w = W.partitionBy("_part", *keys).orderBy("_mix", tie)
    x = df.withColumns({"_part": F.left(hashed, F.lit(3)), "_mix": F.unhex(hashed)}).withColumn(name, F.row_number().over(w).cast("long"))
    x = stored(x.drop("_mix") if keep is None else x.select(*keys, *keep, "_part", name))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = x.groupBy("_part", *keys).agg(F.max(name).alias("_n")).select("_part", *keys, F.sum("_n").over(before).alias("_s"))
    return _with_start(x, stored(starts), keys, ["_s"]).withColumn(name, F.col(name) + F.coalesce("_s", F.lit(0))).drop("_part", "_s")


def segments(df: DataFrame, keys: list[str], ts: str, pause: float, tie: str, name: str = "segment", parts: int | None = None) -> DataFrame:
    """Number of the stretch of a key's rows; a new one begins after more than
    ``pause``.  Rows without a time are left out."""
    x = stored(in_parts(df.where(F.col(ts).isNotNull()), keys, [ts, tie], parts))
    last = x.groupBy("_part", *keys).agg(F.max(ts).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_part")
    x = _with_start(x, last.select("_part", *keys, F.lag("_end").over(before).alias("_end")), keys, ["_end"])
    w = W.partitionBy("_part", *keys).orderBy("_at")
    gap = F.col(ts) - F.coalesce(F.lag(ts).over(w), F.col("_end"))
    x = x.withColumn("_new", F.when(gap.isNull() | (gap > pause), 1).otherwise(0))
    sums = x.groupBy("_part", *keys).agg(F.sum("_new").alias("_t"))
    starts = sums.select("_part", *keys, F.sum("_t").over(before.rowsBetween(W.unboundedPreceding, -1)).alias("_s"))
    x = _with_start(x.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))), starts, keys, ["_s"])
    return x.withColumn(name, F.col(name) + F.coalesce("_s", F.lit(0))).drop("_part", "_at", "_new", "_end", "_s")


# --- greedy matching


def _clamps(keys: list[str]):
    """Each row's composed clamp since its part began, for its key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, low, high = None, -np.inf, np.inf
        for b in batches:
            out = np.empty((4, len(b)))
            key = [*zip(*(b[k] for k in keys), strict=True)] if keys else [()] * len(b)
            for i, (k, least, most) in enumerate(zip(key, b["least"], b["most"], strict=True)):
                if k != now:
                    now, low, high = k, -np.inf, np.inf
                out[:2, i] = low, high
                low, high = min(max(low, least), most), min(max(high, least), most)
                out[2:, i] = low, high
            yield b.assign(before_low=out[0], before_high=out[1], low=out[2], high=out[3])

    return run


def greedy_match(a: DataFrame, b: DataFrame, keys: list[str], lo: float, hi: float, ts: str = "timestamp", tie: str = "packet_id", parts: int | None = None) -> DataFrame:
    """In order, each row of ``a`` takes the next row of ``b`` of its key that no
    earlier row took or passed, if it comes ``lo`` to ``hi`` after: ``keys, t, x, delay``.

    With ``below`` and ``within`` the numbers of b's rows before t + lo and up to t + hi,
    the number of b's rows used or passed after the i-th row of a is
    ``min(max(used + 1, below + 1), within)``.  Less i this is a clamp, and clamps
    compose to clamps: a part of a key's rows is two numbers, whatever its length.
    Rows without a time are left out; of equal times the lesser ``tie`` is first.
    """
    event = lambda df, at, kind: df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("double").alias("t"), F.col(tie).alias("_id"), at.cast("double").alias("_when"), F.lit(kind).alias("_kind"))
    t = F.col(ts).cast("double")
    events = event(a, t + lo, 1).unionByName(event(b, t, 2)).unionByName(event(a, t + hi, 3))
    is_ = lambda k: (F.col("_kind") == k).cast("long")
    x = stored(running_sums(events, keys, ["_when", "_kind", "t", "_id"], parts, begun=is_(1), given=is_(2), ended=is_(3)))
    opened = x.where("_kind = 1").select(*keys, F.col("begun").alias("i"), "t", F.col("given").alias("below"))
    closed = x.where("_kind = 3").select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("ended").alias("_i"), F.col("given").alias("within"))
    both = opened.join(closed, _same(opened, closed, keys) & (opened["i"] == closed["_i"])).select(*keys, "i", "t", "below", "within")
    both = both.withColumn("least", (F.col("below") + 1 - F.col("i")).cast("double")).withColumn("most", (F.col("within") - F.col("i")).cast("double"))
    placed = in_parts(both, keys, ["i"], parts)
    schema = T.StructType([*placed.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("before_low", "before_high", "low", "high")]])
    scanned = stored(placed.mapInPandas(_clamps(keys), schema))
    # the clamps of a key's parts, in order, applied to the start: nothing used
    ends = scanned.groupBy("_part", *keys).agg(F.max_by(F.struct("low", "high"), "i").alias("c")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_part", "c.low", "c.high"))).alias("cs"))
    zero = F.array(F.struct(F.lit(-1).alias("_part"), F.lit(0.0).alias("start"), F.lit(0.0).alias("after")))
    step = lambda done, c: F.concat(done, F.array(F.struct(c["_part"].alias("_part"), F.element_at(done, -1)["after"].alias("start"), F.least(F.greatest(F.element_at(done, -1)["after"], c["low"]), c["high"]).alias("after"))))
    starts = ends.select(*keys, F.explode(F.aggregate("cs", zero, step)).alias("_state")).select(*keys, "_state._part", "_state.start").where("_part >= 0")
    y = _with_start(scanned, starts, keys, ["start"])
    now = F.least(F.greatest("start", "low"), "high") + F.col("i")
    before = F.least(F.greatest("start", "before_low"), "before_high") + F.col("i") - 1
    taken = y.withColumn("_used", now.cast("long")).where(F.col("_used") == F.greatest(before.cast("long"), F.col("below")) + 1).select(*keys, "i", "t", "_used")
    given = x.where("_kind = 2").select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("given").alias("_no"), F.col("t").alias("x"))
    return taken.join(given, _same(taken, given, keys) & (taken["_used"] == given["_no"])).select(*keys, "t", "x", (F.col("x") - F.col("t")).alias("delay"))


# --- chains that use up their rows


def _jumps(key: str, ts: str, what: str, tie: str, ahead: int, lo: float, hi: float, least: int, states: int):
    """Chains of a block and, for each place among its first rows where a scan may come
    in, whether the scan starts there and where it leaves the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block(b: pd.DataFrame) -> pd.DataFrame:
            t, d, ids, place = b[ts].to_numpy(), b[what].tolist(), b[tie].tolist(), b["place"].to_numpy()
            n = int((~b["halo"]).sum())
            chains, jump = [], np.ones(n, dtype=int)
            for i in range(n):
                chain = [i]
                for j in range(i + 1, min(i + 1 + ahead, len(t))):
                    gap = t[j] - t[chain[-1]]
                    if gap >= hi:
                        break
                    if gap > lo and d[j] not in {d[c] for c in chain}:
                        chain.append(j)
                chains.append(chain)
                if len(chain) >= least:
                    jump[i] = len(chain)
            seen, leaves = np.zeros(n, dtype=int), []
            for s in range(states):
                i = s
                while i < n:
                    seen[i] |= 1 << s
                    i += jump[i]
                leaves.append(i - n)
            out = [(place[i], int(seen[i]), [ids[c] for c in chains[i]], None) for i in range(n) if jump[i] >= least]
            out.append((None, None, None, leaves))
            made = pd.DataFrame(out, columns=["place", "seen", "chain", "leaves"])
            return made.assign(**{key: b[key].iloc[0], "block": b["block"].iloc[0]})[[key, "block", "place", "seen", "chain", "leaves"]]

        for b in batches:
            for _, g in b.groupby([key, "block"], sort=False, dropna=False):
                if held and (held[0][key].iloc[0], held[0]["block"].iloc[0]) != (g[key].iloc[0], g["block"].iloc[0]):
                    yield block(pd.concat(held, ignore_index=True))
                    held = []
                held.append(g)
        if held:
            yield block(pd.concat(held, ignore_index=True))

    return run


def consuming_chains(rows: DataFrame, key: str, ts: str, what: str, tie: str, ahead: int = 5, lo: float = 0.01, hi: float = 8.0, least: int = 3, block: int = 4096, parts: int | None = None) -> DataFrame:
    """Chains of rows of a key, each ``lo`` to ``hi`` after the chain's last and new in
    ``what``, sought among the ``ahead`` rows behind their first.  A chain of ``least``
    rows moves the search on by as many rows, any other row by one: ``key, start``
    (the first row's place from 1) and ``tie`` of each row of the chain.

    A row's chain needs only the rows just behind it, and a scan can come into a block
    at one of its first ``ahead + 1`` rows: a block is a map of so few states.  Rows
    without key or time are left out.
    """
    clean = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, what, tie)
    x = ranked(clean, [key], [ts, tie], "place", parts).withColumn("block", F.floor((F.col("place") - 1) / block))
    halo = x.where(((F.col("place") - 1) % block < ahead) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1).withColumn("halo", F.lit(True))
    dealt = x.withColumn("halo", F.lit(False)).unionByName(halo).repartition(key, "block").sortWithinPartitions(key, "block", "place")
    kind, of = rows.schema[key].dataType.simpleString(), rows.schema[tie].dataType.simpleString()
    made = stored(dealt.mapInPandas(_jumps(key, ts, what, tie, ahead, lo, hi, least, ahead + 1), f"`{key}` {kind}, block long, place long, seen int, chain array<{of}>, leaves array<int>"))
    maps = made.where("leaves is not null").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "leaves"))).alias("ms"))
    zero = F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.lit(0).alias("at"), F.lit(0).alias("next")))
    step = lambda done, m: F.concat(done, F.array(F.struct(m["block"].alias("block"), F.element_at(done, -1)["next"].alias("at"), F.get(m["leaves"], F.element_at(done, -1)["next"]).alias("next"))))
    starts = maps.select(F.col(key).alias("_of"), F.explode(F.aggregate("ms", zero, step)).alias("_state")).select("_of", F.col("_state.block").alias("_block"), "_state.at")
    found = made.where("chain is not null").join(starts, (F.col(key) == F.col("_of")) & (F.col("block") == F.col("_block")))
    return found.where(F.expr("(seen & shiftleft(1, at)) <> 0")).select(key, F.col("place").alias("start"), F.explode("chain").alias(tie))
