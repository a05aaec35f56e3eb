"""Packets in random batches give what all packets give at once."""

import random

import pytest

from netloom.operators import traffic
from netloom.streaming.incremental import Incremental

SCHEMA = "packet_id long, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size int"


def packets(seed=1, n=600):
    rng, seen = random.Random(seed), [0] * 12
    rows = []
    for i in range(n):
        k = rng.randint(0, 11)
        ends = (f"10.0.0.{k}", "203.0.113.5", 4000 + k, 443)
        if rng.random() < 0.3:
            ends = (ends[1], ends[0], ends[3], ends[2])
        seen[k] += 1
        t = 1000.0 + (seen[k] * 60 + rng.random() * 5 * (k % 3)) if k < 6 else 1000 + rng.random() * 20_000
        rows.append((i, round(t, 3), *ends, "TCP", rng.randint(40, 1500)))
    rows += [(n, None, "a", "b", 1, 2, "TCP", 1), (n + 1, 1000.0, "10.0.0.1", "203.0.113.5", 4001, 443, "TCP", 7)]
    return rows


def plain(df, *skip):
    same = lambda v: round(v, 3) if isinstance(v, float) else v
    return sorted(tuple(same(r[c]) for c in sorted(df.columns) if c not in skip) for r in df.collect())


def check(spark, state, rows):
    every = spark.createDataFrame(rows, SCHEMA).where("timestamp is not null")
    assert plain(state.flows()) == plain(traffic.aggregate_flows(every))
    want = plain(traffic.detect_beacons(every))
    assert plain(state.beacons()) == want and want


@pytest.mark.parametrize("ordered", [True, False])
def test_batches_equal_one_run(spark, tmp_path, ordered):
    rows = packets()
    if ordered:
        rows.sort(key=lambda r: (r[1] or 0, r[0]))
    else:
        random.Random(3).shuffle(rows)
    state = Incremental(spark, str(tmp_path / "state"), width=3000.0)
    cuts = sorted(random.Random(4).sample(range(1, len(rows)), 3))
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        batch = spark.createDataFrame(rows[a:b], SCHEMA)
        state.add(batch, number)
        if number == 2:  # a batch that runs again
            state.add(batch, number)
    state.add(spark.createDataFrame([], SCHEMA), 9)
    check(spark, state, rows)
    late = state._read("states").groupBy("flow_id", "step").count().where("count > 1").count()
    assert late > 0


def test_stream_stops_and_goes_on(spark, tmp_path):
    rows = packets(2, 300)
    source = tmp_path / "in"
    spark.createDataFrame(rows[:100], SCHEMA).coalesce(1).write.parquet(str(source))
    state = Incremental(spark, str(tmp_path / "state"), width=5000.0)
    stream = lambda: state.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), str(tmp_path / "check")).trigger(availableNow=True).start()
    stream().awaitTermination()
    spark.createDataFrame(rows[100:200], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    spark.createDataFrame(rows[200:], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream().awaitTermination()
    check(spark, state, rows)
    assert state.profiles().count() == 13
