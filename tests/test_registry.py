"""Model versions, training with labels, and cross-validation."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from netloom.operators import models, registry

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        kind = rng.choice(["benign", "benign", "beacon", "scan"])
        at = {"benign": (0, 0), "beacon": (3, 0), "scan": (0, 3)}[kind]
        rows.append((f"f{i}", at[0] + rng.gauss(0, 0.8), at[1] + rng.gauss(0, 0.8), kind))
    return spark.createDataFrame(rows, "flow_id string, a double, b double, label string").cache()


def test_versions_models_and_labels(spark, samples, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    assert reg.active("beacon") is None and reg.versions().isEmpty()
    assert registry.train_models(samples, COLS, ["beacon", "scan", "never"], reg) == {"beacon": 1, "scan": 1}
    listed = {(r.type, r.version): r for r in reg.versions().collect()}
    assert set(listed) == {("beacon", 1), ("scan", 1)} and all(r.active and r.f1 > 0.8 and r.samples > 200 for r in listed.values())
    before = {r.flow_id: r for r in reg.scores(samples, "flow_id", ["beacon", "never"]).collect()}
    again = {r.flow_id: r for r in registry.Registry(spark, str(tmp_path / "reg")).scores(samples, "flow_id", ["beacon", "never"]).collect()}
    assert before == again and all(r.clf_never is None for r in before.values())

    few = samples.where("label = 'beacon'").limit(9).select("flow_id", F.lit("benign").alias("label"))
    assert registry.retrain(samples.drop("label"), samples, few, COLS, ["beacon"], reg) == {"status": "insufficient_labels", "count": 9}
    # analysts call every beacon benign but those far out
    said = samples.where("label = 'beacon'").select("flow_id", F.when(F.col("a") > 4, "beacon").otherwise("benign").alias("label"))
    out = registry.retrain(samples.drop("label"), samples, said, COLS, ["beacon"], reg)
    assert out["status"] == "retrained" and out["labeled_count"] == said.count() and out["versions"] == {"beacon": 2}
    after = {r.flow_id: r for r in reg.scores(samples, "flow_id", ["beacon"]).collect()}
    near = [r.flow_id for r in samples.where("label = 'beacon' and a < 3").collect()]
    assert sum(after[i].clf_beacon < before[i].clf_beacon for i in near) > 0.9 * len(near)
    assert reg.active("beacon")[0] == 2
    reg.retire("beacon", 2)
    assert reg.active("beacon")[0] == 1
    assert [r.version for r in reg.versions().where("active and type = 'beacon'").collect()] == [1]


def test_writers_never_share_a_version(spark, samples, tmp_path):
    model = registry.pipeline(COLS).fit(samples.withColumn("_y", (F.col("label") == "scan").cast("double")))
    regs = [registry.Registry(spark, str(tmp_path / "reg")) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = [*pool.map(lambda i: regs[i % 4].register("scan", model, i, {"accuracy": 1.0, "precision": 1.0, "recall": 1.0, "f1": 1.0}), range(12))]
    assert sorted(got) == [*range(1, 13)]
    assert sorted(r.version for r in regs[0].versions().collect()) == [*range(1, 13)]


def test_folds_and_averages(spark, samples):
    x = registry.folds(samples, "flow_id", "label", 4)
    counts = {(r.label, r.fold): r["count"] for r in x.groupBy("label", "fold").count().collect()}
    assert x.select("flow_id").distinct().count() == 300
    for kind in ("benign", "beacon", "scan"):
        mine = [counts[kind, f] for f in range(4)]
        assert max(mine) - min(mine) <= 1
    got = registry.cross_validate(samples, COLS, k=4)
    names = ["beacon", "benign", "scan"]
    code = F.when(F.col("label") == "beacon", 0.0).when(F.col("label") == "benign", 1.0).otherwise(2.0)
    plain = []
    for f in range(4):
        model = registry.pipeline(COLS).fit(x.where(F.col("fold") != f).withColumn("_y", code))
        pairs = [(r.label, names[int(r._p)]) for r in model.transform(x.where(F.col("fold") == f)).select("label", "_p").collect()]
        tp = sum(t != "benign" and p != "benign" for t, p in pairs)
        precision, recall = tp / sum(p != "benign" for _, p in pairs), tp / sum(t != "benign" for t, _ in pairs)
        plain.append((sum(t == p for t, p in pairs) / len(pairs), precision, recall, 2 * precision * recall / (precision + recall)))
    assert [*got.values()] == pytest.approx([sum(c) / 4 for c in zip(*plain, strict=True)], abs=2e-4)


def test_split_has_the_shares_within_each_label(samples):
    x = models.stratified_split(samples, "label", "flow_id").groupBy("label", "part").count().collect()
    of = {(r.label, r.part): r["count"] for r in x}
    for kind in ("benign", "beacon", "scan"):
        n = sum(of[kind, p] for p in range(3))
        assert [of[kind, p] / n for p in range(3)] == pytest.approx([0.7, 0.15, 0.15], abs=0.03)


def test_cross_validation_reads_the_samples_once(spark, samples):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = registry.cross_validate(samples.mapInArrow(seen, samples.schema), COLS)
    assert read.value == 300 and got == registry.cross_validate(samples, COLS)


def test_folds_guess_as_plain_fits_on_odd_labels_and_columns(spark, samples):
    def plain(x, cols, names, f):
        at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")) - 1
        model = registry.pipeline(cols).fit(x.where(F.col("fold") != f).withColumn("_y", at.cast("double")))
        return [(r.label, names[int(r._p)]) for r in model.transform(x.where(F.col("fold") == f)).select("label", "_p").collect()]

    two = samples.withColumn("label", F.when(F.col("label") == "scan", "scan").otherwise("benign"))
    # a label of one row, which no fit but the others' has seen, and a column that doesn't vary
    lone = samples.withColumn("label", F.when(F.col("flow_id") == "f7", "zz").otherwise(F.col("label"))).withColumn("c", F.lit(0.1))
    for x, cols, share in ((two, COLS, 1 << 17), (lone, [*COLS, "c"], 1 << 17), (samples, COLS, 100)):
        x = registry.folds(x, "flow_id", "label", 3).cache()
        labels, got = models.fold_guesses(x, cols, "label", "fold", 3, share=share)
        for f in range(3):
            pairs = plain(x, cols, labels, f)
            assert got[f].tolist() == [[pairs.count((t, g)) for g in labels] for t in labels]
    one = registry.cross_validate(samples.withColumn("label", F.lit("benign")), COLS)
    assert one == {"accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    assert set(registry.cross_validate(samples.limit(0), COLS).values()) == {0.0}


def test_labels_without_a_name_and_equal_keys_are_dealt_like_others(spark, samples):
    x = samples.withColumn("label", F.when(F.col("label") != "scan", F.col("label"))).unionByName(samples.where("flow_id < 'f2'"))
    for kept in (None, ["a"]):
        got = registry.folds(x, "flow_id", "label", 4, keep=kept)
        assert got.columns == ([*x.columns, "fold"] if kept is None else ["label", "a", "fold"])
        n = {(r.label, r.fold): r["count"] for r in got.groupBy("label", "fold").count().collect()}
        assert sum(n.values()) == x.count()
        for kind in (None, "beacon"):
            mine = [n.get((kind, f), 0) for f in range(4)]
            assert max(mine) - min(mine) <= 1
