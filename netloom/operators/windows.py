"""Sequence and join helpers that the detectors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gaps(df: DataFrame, keys: list[str], ts: str = "timestamp", min_gap: float = 0.0, tie: str | None = None) -> DataFrame:
    """Inter-arrival gaps over ``min_gap`` for each key, as column ``gap``."""
    w = W.partitionBy(*keys).orderBy(ts, *([tie] if tie else []))
    return df.withColumn("gap", F.col(ts) - F.lag(ts).over(w)).where(F.col("gap") > min_gap)


def sliding(df: DataFrame, keys: list[str], ts: str, seconds: float, **aggs: str) -> DataFrame:
    """SQL aggregates over the trailing window ``[ts - seconds, ts]``; equal times
    count.  A frame on a double column needs SQL text for its bounds."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {ts} RANGE BETWEEN {float(seconds)}D PRECEDING AND CURRENT ROW)"
    return df.withColumns({k: F.expr(f"{v} {over}") for k, v in aggs.items()})


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def best_by(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    return first_by(df, keys, [F.desc(score), F.asc(tie)])


def top_n(df: DataFrame, order: list, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def bucketed_range_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_ts: str, right_ts: str, lo: float, hi: float) -> DataFrame:
    """Rows with equal keys and ``lo < right_ts - left_ts < hi``.

    Time is cut into buckets as wide as ``hi``; the right side is filed under its
    bucket and the left one under its own and the next, so the join is an equi
    join and a busy key is spread over its buckets.
    """
    a = left.withColumn("_b", F.explode(F.array(F.floor(F.col(left_ts) / hi), F.floor(F.col(left_ts) / hi) + 1)))
    b = right.withColumn("_c", F.floor(F.col(right_ts) / hi))
    on = (a["_b"] == b["_c"]) & (b[right_ts] - a[left_ts] > lo) & (b[right_ts] - a[left_ts] < hi)
    for x, y in keys:
        on = on & (a[x] == b[y])
    return a.join(b, on).drop("_b", "_c")


def ip_range_join(df: DataFrame, ip_number: str, blocks: DataFrame, wide: int = 1 << 24) -> DataFrame:
    """The first block (by ``block_order``) with start <= ip <= end, left join.

    Blocks are filed under every /8-wide bucket that they touch, so this is an
    equi join; unmatched rows have null block columns.
    """
    b = blocks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_ip") / wide), F.floor(F.col("end_ip") / wide))))
    # joined by address, so a frequent one is looked up once
    ips = df.select(F.col(ip_number).alias("_ip")).where("_ip is not null").distinct()
    hit = ips.withColumn("_b", F.floor(F.col("_ip") / wide)).join(b, "_b").where(F.col("_ip").between(F.col("start_ip"), F.col("end_ip")))
    names = [c for c in blocks.columns if c not in ("start_ip", "end_ip", "block_order")]
    best = hit.groupBy("_ip").agg(F.min_by(F.struct(*names), "block_order").alias("_hit"))
    return df.join(best, df[ip_number] == best["_ip"], "left").select(*[df[c] for c in df.columns], *[F.col(f"_hit.{n}").alias(n) for n in names])


def suffix_join(df: DataFrame, domain: str, indicators: DataFrame, value: str = "value") -> DataFrame:
    """Exact match, else the nearest parent domain's; column ``matched``.

    Distinct domains are exploded into their suffixes, so a frequent domain is
    matched once.
    """
    p = F.split(F.lower(F.col(domain)), r"\.")
    names = df.select(domain).where(F.col(domain).isNotNull()).distinct()
    suffixes = names.select(domain, F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))).alias("level", "suffix"))
    hit = suffixes.join(indicators.select(F.lower(F.col(value)).alias("suffix")).distinct(), "suffix").groupBy(domain).agg(F.min_by("suffix", "level").alias("matched"))
    return df.join(hit, domain, "left")


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``median`` and ``mad`` of a value for each key (exact)."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("median"))
    back = df.join(mid, keys) if keys else df.crossJoin(F.broadcast(mid))
    return back.groupBy(*keys, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def group_entropy(df: DataFrame, keys: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy of the values' distribution for each key."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = F.sum("c")
    return n.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total).alias(name))


def mode(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value for each key; of ties the smallest."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("c")).alias("c"), F.col(value).alias("v"))).alias(name))
