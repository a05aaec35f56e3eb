"""Threat models: features and blends against SQL, the fitted run against numpy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import threat_models as M
from netloom.plans import catalog_models

from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [*catalog_models.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    got, want = catalog_models.queries()[name](spark, SF), duck.sql(catalog_models.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple(str(v) for v in r)
    mine, theirs = sorted(map(tuple, got.select(*cols).collect()), key=key), sorted(want.select(*cols).fetchall(), key=key)
    assert mine and len(mine) == len(theirs)
    assert [x for x in zip(mine, theirs, strict=True) if x[0] != x[1]][:3] == []


def test_ewma_against_a_loop(spark):
    rng = np.random.default_rng(3)
    gaps = [[float(v) for v in rng.exponential(5, n)] for n in (0, 1, 3, 4, 5, 31)] + [[2.0] * 9]
    df = spark.createDataFrame([(i, [[0.0, 0.0, 0.0]] + [[g, 1.0, 1.0] for g in row]) for i, row in enumerate(gaps)], "flow_id int, sequence array<array<double>>")
    for r in M.ewma_scores(df).collect():
        row, want = gaps[r.flow_id], 0.0
        if len(row) >= 4:
            level, off = row[0], []
            for g in row[1:]:
                off.append(abs(g - level))
                level = 0.3 * g + 0.7 * level
            want = min(1.0, max(0.0, 1 - np.mean(off) / max(np.mean(row), 0.001)))
        assert r.ewma == pytest.approx(want, abs=1e-4)


def test_linear_scores_separate_kinds_and_know_absent_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal(2 * (i % 2), 0.3)), float(rng.normal()), "a" if i % 2 else "benign") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, x double, y double, label string")
    out = M.linear_scores(df.where("k < 200"), df, ["x", "y"], ["a", "b"], "k").collect()
    held = [r for r in out if r.k >= 200]
    assert np.mean([(r.clf_a > 0.5) == bool(r.k % 2) for r in held]) > 0.95 and all(r.clf_b == 0.0 for r in out)


def test_run_ranks_one_threat_an_entity(spark):
    f, p = catalog_models._inputs(spark, SF)
    out = M.detect_all(f, p, *catalog_models.labels(f, p), trees=10)
    threats = out["threats"].collect()
    assert threats and len({r.entity for r in threats}) == len(threats)
    assert out["scores"].count() == f.count()
    assert out["clusters"].agg(F.sum("flows")).first()[0] == f.count()
    counted = {r.kind: r.threats for r in out["counters"].collect()}
    assert counted["malware_beaconing"] and set(counted) <= set(M.TECHNIQUES)


def test_odd_flows(spark):
    cols = "flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, packet_count int, total_bytes long, session_duration double, tls_version string, sni string, ja3 string"
    packets = "flow_id string, packet_id long, timestamp double, size int, dns_query string"
    rows = [("n",) + (None,) * 10, ("z", "1.1.1.1", "2.2.2.2", 443, "TLS", 0, 0, 0.0, "", "", "")]
    got = {r.flow_id: r for r in M.flow_features(spark.createDataFrame(rows, cols), spark.createDataFrame([("z", 1, 1.0, 0, ""), (None, 2, 1.0, 5, "a.b")], packets)).collect()}
    assert set(got) == {"n", "z"} and all(got[k][f] is not None for k in got for f in M.FEATURES)
    assert M.flow_features(spark.createDataFrame([], cols), spark.createDataFrame([], packets)).count() == 0


def test_features_deal_flows_by_id_alone_and_volumes_read_them_once(spark):
    flows = spark.createDataFrame([(f"f{i}", f"10.0.0.{i % 3}", "8.8.8.8", 443, "TLS", 3, 10 * i, 1.0, "TLS 1.0", "a.b", "j") for i in range(12)], "flow_id string, src_ip string, dst_ip string, dst_port int, protocol string, packet_count long, total_bytes long, session_duration double, tls_version string, sni string, ja3 string")
    packets = spark.createDataFrame([(1, "f1", 1.0, 5, None)], "packet_id long, flow_id string, timestamp double, size int, dns_query string")
    x = M.flow_features(flows, packets)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 5  # flows and the packets' four reads; fans and fingerprints are tables of their own
    assert {(r.sni_entropy, r.ja3_rarity, r.interval_mean) for r in x.collect()} == {(1.585, 0.0, 0.0)}
    scored = x.withColumns({"clf": F.lit(1.0), "iso": F.lit(0.5)})
    once = M.abnormal_threats(scored)
    assert "LogicalRDD" not in once._jdf.queryExecution().optimizedPlan().toString() and once.count() == 12


def test_fits_reach_the_least_loss_and_take_few_passes(spark, monkeypatch):
    from netloom.operators import models

    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 3)) * [1, 100, 0] + [0, 5, 2]
    kind = np.where(x[:, 0] + rng.normal(size=3000) > 1, 0, np.where(x[:, 1] > 150, 1, -1))
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, kind, strict=True)], "a double, b double, c double, k int").repartition(3)
    passes = []
    real = models._newton_sums
    monkeypatch.setattr(models, "_newton_sums", lambda *a: passes.append(len(a[2])) or real(*a))
    got, begun = models.logistic_fits(df, ["a", "b", "c"], "k", [0, 1]), len(passes)
    again = models.logistic_fits(df, ["a", "b", "c"], "k", [0, 1], share=1000)
    z = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0, ddof=1)
    for k, (coef, other) in enumerate(zip(got, again, strict=True)):
        assert coef[3] == 0 and coef == pytest.approx(other, rel=1e-4)
        m, std = coef[0] + x @ coef[1:], coef[1:3] * x[:, :2].std(0, ddof=1)
        off = 1 / (1 + np.exp(-m)) - (kind == k)
        assert abs(off.mean()) < 1e-5 and np.abs(z.T @ off / 3000 + 0.001 * std).max() < 1e-5
    assert begun < 20 and max(passes) == 2


def test_a_rare_kind_starts_near_and_takes_few_passes(spark, monkeypatch):
    from netloom.operators import models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 2))
    kind = np.where(x[:, 0] > 2.4, 0, -1)  # some fifty rows, set apart by a line
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, kind, strict=True)], "a double, b double, k int").repartition(3)
    whole, real = [], models._newton_sums
    monkeypatch.setattr(models, "_newton_sums", lambda *a: (len(a) > 6 or whole.append(1)) and None or real(*a))
    near = models.logistic_fits(df, ["a", "b"], "k", [0], share=2000)
    few = len(whole)
    far = models.logistic_fits(df, ["a", "b"], "k", [0])
    assert near[0] == pytest.approx(far[0], rel=1e-3) and few <= 4 < len(whole) - few


def test_rates_weigh_points_by_their_rows(spark):
    rows = [(i, 0.0, "benign" if i % 4 else "tor_c2") for i in range(40)] + [(40 + i, 9.0, None if i else "tor_c2") for i in range(3)]
    df = spark.createDataFrame(rows, "k int, x double, label string")
    got = {r.k: r.rate for r in M.cluster_rates(df, df, ["x"], "k", k=2).collect()}
    assert {got[i] for i in range(40)} == {0.25} and {got[i] for i in range(40, 43)} == {1.0}


def test_threats_alone_cluster_no_flows_and_keep_nothing_in_memory(spark, monkeypatch):
    f, p = catalog_models._inputs(spark, SF)
    monkeypatch.setattr(M, "cluster_profiles", None)
    out = M.detect_all(f, p, *catalog_models.labels(f, p), trees=5, parts=("threats",))
    assert set(out) == {"threats"} and out["threats"].count() > 0
    assert not any("RDD" in line for line in out["threats"]._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_flows_are_dealt_by_id_without_their_texts(spark):
    flows, packets = catalog_models._inputs(spark, SF)
    lines = M.flow_features(flows, packets)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deal = next(i for i, line in enumerate(lines) if "Join LeftOuter, (flow_id" in line)
    kept = next(line for line in lines[deal:] if "Project [" in line).split("Project [")[1].split(", CASE")[0]
    assert "total_bytes" in kept and not any(f" {c}#" in f" {kept}" for c in ("sni", "ja3", "tls_version"))
