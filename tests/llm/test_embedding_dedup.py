"""Near copies of embeddings against all pairs."""

import math

import numpy as np
import pytest

from netloom.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<double>, label int, cls long, copies int, label_text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, 1, 2, "x") for i, v, lab in rows], SCHEMA)


def usable(v, lab):
    return lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows):
    """Links of each row and the least id it reaches, by all pairs."""
    good = [i for i, (_, v, lab) in enumerate(rows) if usable(v, lab)]
    near = {i: set() for i in range(len(rows))}
    groups = {}
    for i in good:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for mine in groups.values():
        x = dedup.units([np.array(rows[i][1]) for i in mine])
        for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True):
            if a != b:
                near[mine[a]].add(mine[b])
    root = {}
    for i in near:
        if i not in root:
            seen, front = {i}, [i]
            while front:
                front = [k for j in front for k in near[j] if k not in seen and not seen.add(k)]
            ids = [rows[k][0] for k in seen if rows[k][0] is not None]
            root |= dict.fromkeys(seen, min(ids) if ids else None)
    return near, root


def expected(rows):
    near, root = plain(rows)
    return sorted(((r[0], len(near[i]), root[i], r[0] == root[i]) for i, r in enumerate(rows)), key=str)


def result(df, **how):
    return sorted((tuple(r) for r in dedup.near_copies(df, **how).collect()), key=str)


def families(seed, n, dim, spread, labels=3):
    """Vectors around a few centres, some at the very threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(2, n // 12), dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(len(centres))]
        rows.append((int(i * 3 % n), (c + rng.choice(spread) * np.linalg.norm(c) / math.sqrt(dim) * rng.standard_normal(dim)).tolist(), int(rng.integers(labels))))
    return rows


def test_whole_links_without_an_index(spark):
    """One cell holds everything, so that blocks and balls are all that is tried."""
    rows = families(1, 900, 16, [0.05, 0.2, 0.28, 0.5], 2)
    want = expected(rows)
    df = frame(spark, rows).repartition(4)
    assert any(w[1] for w in want)
    for block in (4096, 64):
        assert result(df, codes=1, block=block) == want


def test_recall_and_nothing_below_the_threshold(spark):
    rows = families(2, 3000, 64, [0.1, 0.27, 0.28], 2)
    near, _ = plain(rows)
    df = frame(spark, rows)
    got = {r.vec_id: r for r in dedup.near_copies(df, block=256).collect()}
    links = {rows[i][0]: len(n) for i, n in near.items()}
    assert all(got[i].n_links <= n for i, n in links.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values()) > 1000


def test_a_hot_group_is_counted_by_balls(spark):
    rng = np.random.default_rng(3)
    c = rng.standard_normal(64)
    rows = [(i, (c + 0.08 * rng.standard_normal(64)).tolist(), 1) for i in range(2500)]
    rows += [(10_000 + i, c.tolist(), 1) for i in range(700)] + [(20_000 + i, rng.standard_normal(64).tolist(), 1) for i in range(300)]
    assert result(frame(spark, rows), block=128) == expected(rows)


def test_odd_rows(spark):
    big, tiny = [1e300, 1e300], [1e-310, 1e-310]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, math.nan], 1), (6, [math.inf, 1.0], 1), (7, [1.0, 1.0], None)]
    rows += [(8, big, 1), (9, tiny, 1), (10, [1.0, 1.0], 1), (10, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (11, [1.0, 1.0], 2), (12, [1.0, 1.0, 1.0], 1), (None, [5.0], 1), (13, [-5.0], 1)]
    rows += [(14, [1.0, -1.0], 1), (15, [-0.0, 1.0], 3), (16, [0.0, 1.0], 3), (None, None, None), (None, [3.0], 9), (None, [4.0], 9)]
    got = result(frame(spark, rows))
    want = [(i, n, r, i == r) for i, n, r, _ in expected(rows)]
    assert got == sorted(want, key=str)
    assert dedup.near_copies(frame(spark, rows[:7])).where("not kept or n_links > 0").isEmpty()
    assert dedup.near_copies(frame(spark, rows).limit(0)).isEmpty()


@pytest.mark.parametrize("k", [1, 2, 5, 9])
def test_traversal_comes_in_order_and_stops(k):
    rng = np.random.default_rng(k)
    left, right = np.sort(rng.random(k)).tolist(), np.sort(rng.random(k)).tolist()
    for margin in (0.0, 0.3, 5.0):
        got = [*dedup.traverse(left, right, [*range(k)], [*range(k)], margin)]
        sums = {r * k + c: left[r] + right[c] for r in range(k) for c in range(k)}
        assert [sums[c] for c in got] == sorted(x for x in sums.values() if x <= left[0] + right[0] + margin)
        assert len(set(got)) == len(got)
