"""Correlation of two sets of flows in time against plain loops."""

import math
import random
import statistics

from netloom.operators import stepping
from tests.test_scans import plain_match


def plain(a, b, lo, hi, least=10):
    """Score of each pair of flows, from the lists of their packets' times."""
    out = {}
    for ka, ta in a.items():
        for kb, tb in b.items():
            ta, tb = sorted(t for t in ta if t), sorted(t for t in tb if t)
            if len(ta) < least or len(tb) < least or min(ta[-1], tb[-1]) <= max(ta[0], tb[0]):
                continue
            d = [x - t for t, x in plain_match(ta, tb, lo, hi)]
            if len(d) < least:
                continue
            gaps = [[y - x for x, y in zip(t, t[1:], strict=False) if y > x] for t in (ta, tb)]
            n = min(map(len, gaps))
            r = 0.0
            if n >= 5:
                mx, my = (statistics.mean(g[:n]) for g in gaps)
                num = sum((x - mx) * (y - my) for x, y in zip(*gaps, strict=False))
                den = math.sqrt(sum((x - mx) ** 2 for x in gaps[0][:n]) * sum((y - my) ** 2 for y in gaps[1][:n]))
                r = round(num / den, 4) if den else 0.0
            cv = statistics.stdev(d) / statistics.mean(d)
            score = 0.3 * min(1, len(d) / (len(ta) * 0.5)) + 0.3 * max(0, 1 - cv) + 0.4 * max(0, r)
            if score >= 0.3:
                out[ka, kb] = (len(d), round(statistics.mean(d), 3), round(score, 3))
    return out


def test_pairs_equal_a_plain_loop(spark):
    rng = random.Random(8)
    a = {f"in{k}": [1000 + rng.random() * rng.choice([20, 300]) for _ in range(rng.choice([5, 12, 60]))] for k in range(6)}
    b = {f"out{k}": [1000 + rng.random() * rng.choice([20, 300]) for _ in range(rng.choice([5, 12, 60]))] for k in range(6)}
    b["echo"] = [t + 0.4 + 0.01 * rng.random() for t in a["in2"]] + [0.0]
    a["hot"] = [1000 + 0.1 * i + 0.05 * rng.random() for i in range(1500)]
    b["hot echo"] = [t + 0.3 for t in a["hot"]] + [a["hot"][7] + 0.3]
    rows = lambda d: [(k, t, i) for i, (k, t) in enumerate((k, t) for k, ts in d.items() for t in ts)] + [("x", None, 10**6)]
    schema = "flow_id string, timestamp double, packet_id long"
    want = plain(a, b, 0.05, 5.0)
    for parts in (None, 5):
        got = stepping.correlate_timing(spark.createDataFrame(rows(a), schema), spark.createDataFrame(rows(b), schema), parts=parts).collect()
        assert {(r.in_key, r.out_key): (r.samples, round(r.delay_mean, 3), round(r.score, 3)) for r in got} == want
    assert ("hot", "hot echo") in want and len(want) > 3
    assert {(r.in_key, r.out_key) for r in got if r.confidence == "CRITICAL"} >= {("hot", "hot echo"), ("in2", "echo")}


def test_slabs_hand_on_what_is_used(spark):
    rng = random.Random(3)
    # dense flows, so that most packets wait and every slab ends with packets of the next used
    a = {f"in{k}": [1000 + rng.choice([0.25 * i, rng.uniform(0, 90)]) for i in range(90)] for k in range(4)}
    b = {f"out{k}": [1002 + rng.choice([0.25 * i, rng.uniform(0, 90)]) for i in range(60)] for k in range(3)}
    rows = lambda d: [(k, t, i) for i, (k, t) in enumerate((k, t) for k, ts in d.items() for t in ts)]
    schema = "flow_id string, timestamp double, packet_id long"
    for n in (20, 150, 1 << 16):
        got = stepping.correlate_timing(spark.createDataFrame(rows(a), schema), spark.createDataFrame(rows(b), schema), rows=n).collect()
        want = plain(a, b, 0.05, 5.0)
        assert {(r.in_key, r.out_key) for r in got} == set(want) and len(want) > 5
        assert all(r.samples == n and abs(r.delay_mean - mean) < 0.001 and abs(r.score - score) < 0.001 for r in got for n, mean, score in [want[r.in_key, r.out_key]])


def test_nothing_to_correlate(spark):
    none = spark.createDataFrame([], "flow_id string, timestamp double, packet_id long")
    assert stepping.correlate_timing(none, none).isEmpty()
