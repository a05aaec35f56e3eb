"""Scans dealt over many parts against plain loops."""

import random

import pytest

from netloom.operators import scans


def plain_match(a, b, lo, hi):
    out, i = [], 0
    for t in sorted(a):
        while i < len(b) and b[i] < t + lo:
            i += 1
        if i >= len(b):
            break
        if b[i] <= t + hi:
            out.append((t, b[i]))
            i += 1
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_greedy_match_equals_two_pointers(spark, parts):
    rng = random.Random(4)
    a, b = [], []
    for k in range(12):
        span = rng.choice([2.0, 40.0, 400.0])
        for rows in (a, b):
            rows += [(k, "x", round(rng.random() * span, rng.choice([1, 3])), n) for n in range(rng.choice([0, 1, 30, 60]))]
    hot = 900
    for rows in (a, b):  # one busy pair over all parts, no pause anywhere
        rows += [(99, "x", round(rng.random() * 120, 2), n) for n in range(hot)]
    a.append((99, "x", None, 5000))
    schema = "k int, s string, timestamp double, packet_id long"
    got = scans.greedy_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k", "s"], 0.05, 5.0, parts=parts).collect()
    want = {(k, *m) for k in {r[0] for r in a} for m in plain_match([r[2] for r in a if r[0] == k and r[2] is not None], sorted(r[2] for r in b if r[0] == k), 0.05, 5.0)}
    assert len([g for g in got if g.k == 99]) > 500
    assert sorted((r.k, r.t, r.x) for r in got) == sorted(m for k in {r[0] for r in a} for m in [(k, *p) for p in plain_match([r[2] for r in a if r[0] == k and r[2] is not None], sorted(r[2] for r in b if r[0] == k), 0.05, 5.0)])
    assert {(r.k, r.t, r.x) for r in got} == want


def test_greedy_match_of_nothing(spark):
    none = spark.createDataFrame([], "k int, timestamp double, packet_id long")
    assert scans.greedy_match(none, none, ["k"], 0.05, 5.0).isEmpty()


def test_running_sums_and_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 400), i, rng.randint(0, 9)) for i in range(2000)]
    got = scans.running_sums(spark.createDataFrame(rows, "k int, t int, i int, v int"), ["k"], ["t", "i"], 6, total=scans.F.col("v"), no=scans.F.lit(1)).collect()
    for k in (1, 2, None):
        total = 0
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        at = {r.i: (r.no, r.total) for r in got if r.k == k}
        assert len(at) == len(mine)
        for no, r in enumerate(mine, 1):
            total += r[3]
            assert at[r[2]] == (no, total)


def test_a_hot_key_is_many_parts(spark):
    rows = spark.range(3000).selectExpr("1 as k", "id as t", "id")
    x = scans.in_parts(rows, ["k"], ["t"], 6).groupBy("_part").count().collect()
    assert len(x) == 6 and max(r["count"] for r in x) < 1200


def test_segments(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, *[float(rng.randint(0, 3000)) for _ in range(9)]]), i) for i in range(600)]
    got = {r.i: r.segment for r in scans.segments(spark.createDataFrame(rows, "k string, t double, i int"), ["k"], "t", 12.0, "i", parts=5).collect()}
    for k in "ab":
        last, no = None, 0
        for _, t, i in sorted(r for r in rows if r[0] == k and r[1] is not None):
            no += last is None or t - last > 12.0
            assert got.pop(i) == no
            last = t
    assert not got


def plain_chains(flows, ahead=5, least=3):
    out, i = set(), 0
    flows = sorted(flows, key=lambda f: (f[0], f[2]))
    while i < len(flows) - 2:
        chain, used = [i], {flows[i][1]}
        for j in range(i + 1, min(i + 1 + ahead, len(flows))):
            gap = flows[j][0] - flows[chain[-1]][0]
            if 0.01 < gap < 8.0 and flows[j][1] not in used:
                chain.append(j)
                used.add(flows[j][1])
            elif gap >= 8.0:
                break
        if len(chain) >= least:
            out.add((i + 1, tuple(c + 1 for c in chain)))
            i += len(chain)
        else:
            i += 1
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_consuming_chains_equal_a_loop(spark, block):
    rng = random.Random(7)
    rows, i = [], 0
    for k, n, step in (("a", 500, 2.0), ("b", 60, 9.0), ("c", 2, 1.0), ("d", 300, 5.0), (None, 5, 1.0)):
        t = 0.0
        for _ in range(n):
            t += rng.choice([0.0, 0.005, rng.random() * step])
            rows.append((k, round(t, 3), f"h{rng.randint(0, 5)}", i, "z"))
            i += 1
    rows.append(("a", None, "h", i, "z"))
    df = spark.createDataFrame(rows, "src string, start double, dst string, id int, block string").drop("block")
    got = {}
    for r in scans.consuming_chains(df, "src", "start", "dst", "id", block=block, parts=4).collect():
        got.setdefault((r.src, r.start), []).append(r.id)
    for k in "abcd":
        place = {r[3]: n for n, r in enumerate(sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: (r[1], r[3])), 1)}
        mine = {(s, tuple(sorted(place[i] for i in p))) for (key, s), p in got.items() if key == k}
        assert mine == plain_chains([r[1:4] for r in rows if r[0] == k and r[1] is not None])
