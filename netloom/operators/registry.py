"""Training, cross-validation, retraining and a registry of model versions."""

from __future__ import annotations

import json
import os
import time
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.models import fold_guesses, stratified_split
from netloom.operators.scans import ranked_by_hash, stored

VERSIONS = "type string, version int, model_id string, created double, path string, samples long, accuracy double, precision double, recall double, f1 double, active boolean"


class Registry:
    """Versions of models in a folder that driver and executors share.

    A version's number is claimed by creating a file that must not exist yet, so two
    writers never hold the same one; its entry is written aside and renamed, so a reader
    sees all of it or nothing.  The active version of a type is the highest that isn't
    retired.  A claim whose writer was lost is a number that no version has.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("models", "claims", "entries", "retired"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _names(self, part: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}"))]

    def _claim(self, name: str) -> bool:
        """Creates a file; false if it was there."""
        path = f"{self.folder}/claims/{name}"
        if self._fs.getScheme() == "file":  # Hadoop's local files may be created twice
            try:
                os.close(os.open(self._path(path).toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        from py4j.protocol import Py4JJavaError

        try:
            self._fs.create(self._path(path), False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _write(self, name: str, text: str) -> None:
        aside = self._path(f"{self.folder}/entries/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(aside, self._path(f"{self.folder}/entries/{name}"))

    def register(self, kind: str, model: PipelineModel, samples: int, metrics: dict[str, float]) -> int:
        """Stores the model as the next version of its type and returns the version."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/models/{name}"
        model.write().save(path)
        version = 1 + max([int(n.rpartition(".")[2]) for n in self._names("claims") if n.rpartition(".")[0] == kind], default=0)
        while not self._claim(f"{kind}.{version}"):
            version += 1
        entry = {"type": kind, "version": version, "model_id": name, "created": time.time(), "path": path, "samples": samples, **metrics}
        self._write(f"{kind}.{version}.json", json.dumps(entry))
        return version

    def retire(self, kind: str, version: int) -> None:
        self._fs.create(self._path(f"{self.folder}/retired/{kind}.{version}"), True).close()

    def versions(self) -> DataFrame:
        """All versions with their metrics; ``active`` marks one of each type."""
        x = self.spark.read.schema(VERSIONS.replace(", active boolean", "")).json(f"{self.folder}/entries")
        gone = self.spark.createDataFrame([(n,) for n in self._names("retired")], "name string")
        x = x.withColumn("name", F.concat_ws(".", "type", "version"))
        x = x.join(gone.withColumn("retired", F.lit(True)), "name", "left")
        best = x.where("retired is null").groupBy("type").agg(F.max("version").alias("best"))
        return x.join(best, "type", "left").select(*[c.split()[0] for c in VERSIONS.split(", ")[:-1]], F.coalesce(F.col("version") == F.col("best"), F.lit(False)).alias("active"))

    def active(self, kind: str) -> tuple[int, PipelineModel] | None:
        got = self.versions().where((F.col("type") == kind) & F.col("active")).first()
        return got and (got.version, PipelineModel.load(got.path))

    def scores(self, rows: DataFrame, key: str, kinds: list[str]) -> DataFrame:
        """``key`` and ``clf_<kind>``, the probability that each type's active model
        gives; null for a type without one."""
        out = rows
        for kind in kinds:
            found = self.active(kind)
            out = out.withColumn(f"clf_{kind}", F.lit(None).cast("double")) if found is None else probability(found[1], out, f"clf_{kind}")
        return out.select(key, *[f"clf_{k}" for k in kinds])


_SPARE = ["_raw", "_in", "_r", "_q", "_p"]


def pipeline(cols: list[str], regularised: float = 0.001) -> Pipeline:
    """Columns scaled to [0, 1] as in training, then logistic regression of ``_y``."""
    gather = VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="keep")
    scale = MinMaxScaler(inputCol="_raw", outputCol="_in")
    fit = LogisticRegression(featuresCol="_in", labelCol="_y", rawPredictionCol="_r", probabilityCol="_q", predictionCol="_p", maxIter=50, regParam=regularised)
    return Pipeline(stages=[gather, scale, fit])


def probability(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, F.round(vector_to_array("_q")[1], 6)).drop(*_SPARE)


def rates(n: float, right: float, tp: float, fp: float, fn: float) -> dict[str, float]:
    share = lambda a, b: float(a / b) if b else 0.0
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    got = {"accuracy": share(right, n), "precision": precision, "recall": recall, "f1": share(2 * precision * recall, precision + recall)}
    return {k: round(v, 4) for k, v in got.items()}


def metrics(judged: DataFrame, truth: str, prediction: str, positive: list[str]) -> dict[str, float]:
    """Accuracy over all labels; precision, recall and f1 of being one of ``positive``."""
    y, p = F.col(truth).isin(*positive), F.col(prediction).isin(*positive)
    n = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(prediction)).alias("right"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")).first()
    return rates(n.n, n.right, n.tp, n.fp, n.fn)


def _in_parallel(run, items: list, threads: int) -> list:
    """Spark jobs of several fits at once; the first failure is raised."""
    with ThreadPool(min(threads, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.getActiveSession())(run), items)


def train_models(samples: DataFrame, cols: list[str], kinds: list[str], registry: Registry, key: str = "flow_id", label: str = "label", threads: int = 4) -> dict[str, int]:
    """A model of each kind against all else, fitted on the training part of the labelled
    samples, judged on the test part and registered; the versions by kind.  A kind that
    no training row, or every one, is labelled with gets no version."""
    x = stored(stratified_split(samples.where(F.col(label).isNotNull()).na.fill(0.0, cols), label, key))
    fit, test = x.where("part = 0"), x.where("part = 2")
    seen = {r[label]: r["count"] for r in fit.groupBy(label).count().where(F.col(label).isin(*kinds)).collect()}
    n = fit.count()

    def one(kind: str) -> tuple[str, int]:
        y = F.when(F.col(label) == kind, 1.0).otherwise(0.0)
        model = pipeline(cols).fit(fit.withColumn("_y", y))
        judged = probability(model, test, "_prob").select(F.when(F.col(label) == kind, kind).otherwise("other").alias("truth"), F.when(F.col("_prob") >= 0.5, kind).otherwise("other").alias("guess"))
        return kind, registry.register(kind, model, n, metrics(judged, "truth", "guess", [kind]))

    due = [k for k in kinds if 0 < seen.get(k, 0) < n]
    return dict(_in_parallel(one, due, threads)) if due else {}


def retrain(features: DataFrame, base: DataFrame, analyst: DataFrame, cols: list[str], kinds: list[str], registry: Registry, key: str = "flow_id", label: str = "label", least: int = 10) -> dict:
    """Trains anew with analysts' labels (``key, label``) beside the base labels; where
    both name a row the analyst's counts.  Under ``least`` analysts' labels of known rows
    nothing is trained."""
    known = stored(features.join(analyst.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(label)), key))
    n = known.count()
    if n < least:
        return {"status": "insufficient_labels", "count": n}
    rest = features.join(base.select(key, label), key).join(known.select(key), key, "left_anti")
    every = rest.unionByName(known)
    return {"status": "retrained", "labeled_count": n, "versions": train_models(every, cols, kinds, registry, key, label)}


def folds(samples: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, name: str = "fold", keep: list[str] | None = None) -> DataFrame:
    """``fold`` 0 to k - 1, dealt in turn within each label in an order fixed by seed and
    key, beside all columns, or the label and those in ``keep``.  Ranks are summed over
    parts, so no label is ordered in one task."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return ranked_by_hash(samples, [label], mixed, key, "_rank", keep).withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def cross_validate(samples: DataFrame, cols: list[str], key: str = "flow_id", label: str = "label", k: int = 5, seed: int = 42, benign: str = "benign") -> dict[str, float]:
    """Averages over ``k`` folds of accuracy over all labels and of precision, recall and
    f1 of not being ``benign``; one multinomial fit a fold, all in the same passes.
    ``samples`` is read once."""
    known = samples.where(F.col(label).isNotNull()).na.fill(0.0, cols).withColumn(label, F.col(label).cast("string"))
    labels, guessed = fold_guesses(folds(known, key, label, k, seed, keep=cols), cols, label, "fold", k)
    threat = np.array([n != benign for n in labels], dtype=bool)
    got = [rates(g.sum(), np.trace(g), g[threat][:, threat].sum(), g[~threat][:, threat].sum(), g[threat][:, ~threat].sum()) for g in guessed]
    return {m: round(sum(g[m] for g in got) / k, 4) for m in got[0]}
