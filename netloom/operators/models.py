"""Feature scaling, splits, scores and the isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.scans import ranked_by_hash, stored


def ja3_rarity(flows: DataFrame) -> DataFrame:
    """``1 - count / all`` of each fingerprint among flows that have one."""
    n = flows.where("ja3 is not null").groupBy("ja3").agg(F.count(F.lit(1)).alias("flows"))
    total = n.agg(F.sum("flows").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("ja3", "flows", F.round(1 - F.col("flows") / F.col("total"), 4).alias("rarity"))


def min_max(df: DataFrame, cols: list[str], state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Columns scaled to [0, 1] and clipped; a constant column becomes 0.  Returns
    the rows and the one-row state (``<c>_lo``, ``<c>_hi``) for later tables."""
    if state is None:
        state = df.agg(*[F.min(c).cast("double").alias(f"{c}_lo") for c in cols], *[F.max(c).cast("double").alias(f"{c}_hi") for c in cols])
    span = lambda c: F.col(f"{c}_hi") - F.col(f"{c}_lo")
    scaled = {c: F.when(span(c) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.col(f"{c}_lo")) / span(c)))).otherwise(0.0) for c in cols}
    return df.crossJoin(F.broadcast(state)).withColumns(scaled).select(*df.columns), state


def stratified_split(df: DataFrame, label: str, key: str, parts=(0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``part`` 0, 1, 2 within each label, in an order fixed by seed and key.  Ranks
    are summed over parts of the order, so no label is ordered in one task."""
    x = ranked_by_hash(df, [label], F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key, "_rank")
    n = x.groupBy(F.col(label).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, F.col(label).eqNullSafe(F.col("_of")))
    place = F.when(F.col("_n") > 1, (F.col("_rank") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return x.withColumn("part", F.when(place < parts[0], 0).when(place < parts[0] + parts[1], 1).otherwise(2)).select(*df.columns, "part")


def _merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Numbers of rows, means, squared distances from them, least and greatest values of
    columns, one in a row each, of two sets of rows together."""
    if a is None:
        return b
    n, off = a[0] + b[0], b[1] - a[1]
    return np.array([n, a[1] + off * b[0] / n, a[2] + b[2] + off * off * a[0] * b[0] / n, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])])


def _measures(cols: list[str]):
    """A part's ``_merged`` numbers: one row a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = [b.column(c).to_numpy(zero_copy_only=False) for c in cols]
                mean = [v.mean() for v in x]
                total = _merged(total, np.array([[len(v) for v in x], mean, [np.sum((v - m) ** 2) for v, m in zip(x, mean, strict=True)], [v.min() for v in x], [v.max() for v in x]]))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _newton_sums(cols: list[str], of: str, numbers: list[int], mean: np.ndarray, scale: np.ndarray, at: np.ndarray, weight: str | None = None):
    """A part's loss, slope and curvature of each fit at its coefficients: one row a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, total = len(cols) + 1, None
        for b in batches:
            z = np.ones((b.num_rows, d))
            for i, c in enumerate(cols):
                z[:, i + 1] = (b.column(c).to_numpy(zero_copy_only=False) - mean[i]) / scale[i]
            kind, made = b.column(of).to_numpy(zero_copy_only=False), []
            w = b.column(weight).to_numpy(zero_copy_only=False) if weight else 1.0
            for k, coef in zip(numbers, at, strict=True):
                y, m = (kind == k).astype(float), z @ coef
                p = 0.5 * (1 + np.tanh(m / 2))
                made += [[np.sum(w * (np.logaddexp(0.0, m) - y * m))], z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()]
            made = np.concatenate(made)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    return run


def logistic_fits(train: DataFrame, cols: list[str], of: str, numbers: list[int], penalty: float = 0.001, most: int = 50, near: float = 1e-10, share: int = 1 << 17) -> list[np.ndarray]:
    """Logistic regressions of ``of`` being each of ``numbers``, as intercept and
    coefficients, all by Newton's method in one pass a step.

    Mean loss and half the penalty on the squared coefficients of standardised columns,
    as in ``pyspark.ml``, whose gradient method takes some fifty passes a fit.  A pass
    gives each part's sums, ``(d + 1)(d + 2) + 1`` numbers a fit, whatever its rows; no row
    is kept in memory.  A step that raises the loss is halved.  Of many rows about
    ``share``, as many of each number and of the others as there are, first give where to
    start, each row weighing what it stands for; the steps that count go over all rows,
    until they have converged.  ``train`` is read once a step, so it should be stored; a
    column that doesn't vary has coefficient 0.
    """
    held = {r["_k"]: r["count"] for r in train.groupBy(F.when(F.col(of).isin(numbers), F.col(of)).alias("_k")).count().collect()}
    whole = sum(held.values())
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(of).cast("long").alias(of))
    known = None
    for r in rows.mapInArrow(_measures(cols), "sums array<double>").collect():
        known = _merged(known, np.array(r["sums"]).reshape(5, -1))
    spread = np.sqrt(known[2] / max(whole - 1, 1))
    used = np.flatnonzero((known[3] < known[4]) & (spread > 0))
    mean, scale = known[1][used], spread[used]
    d, names, ridge = len(used) + 1, [cols[i] for i in used], np.diag([0.0] + [penalty] * len(used))
    rows = rows.select(*names, of)

    def steps(sums, n: float, start: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        fits = {k: [None, np.inf, at] for k, at in start.items()}  # the last coefficients, their loss, and those to try
        due = [*fits]
        for _ in range(most):
            if not due:
                break
            total, going = np.sum(sums(due, np.array([fits[k][2] for k in due])), axis=0).reshape(len(due), -1) / n, []
            for k, t in zip(due, total, strict=True):
                last, lowest, now = fits[k]
                loss = t[0] + 0.5 * now @ ridge @ now
                if loss > lowest + 1e-12:
                    fits[k][2] = (last + now) / 2
                    going.append(k)
                    continue
                slope, curve = t[1 : d + 1] + ridge @ now, t[d + 1 :].reshape(d, d) + ridge
                step = np.linalg.lstsq(curve, slope, rcond=None)[0]
                fits[k] = [now, loss, now - step]
                if slope @ step > near:
                    going.append(k)
            due = going
        return {k: f[2] for k, f in fits.items()}

    start = {k: np.array([np.log(held[k] / (whole - held[k]))] + [0.0] * len(used)) for k in numbers}
    if whole > 2 * share:
        part = {k: min(1.0, share / len(held) / n) for k, n in held.items()}
        rate = F.coalesce(*[F.when(F.col(of) == k, v) for k, v in part.items() if k is not None], F.lit(part.get(None, 1.0)))
        some = rows.withColumn("_w", 1 / rate).where(F.rand(42) < rate).toArrow()
        kind, weight = some.column(of).to_numpy(), some.column("_w").to_numpy()
        near_by = lambda due, at: [b.column(0)[0].as_py() for b in _newton_sums(names, of, due, mean, scale, at, "_w")(some.to_batches(max_chunksize=1 << 14))]
        start |= steps(near_by, weight.sum(), {k: start[k] for k in numbers if 0 < np.sum(kind == k) < len(kind)})
    every = lambda due, at: [p["sums"] for p in rows.mapInArrow(_newton_sums(names, of, due, mean, scale, at), "sums array<double>").collect()]
    final = steps(every, whole, start)
    out = []
    for k in numbers:
        coef = np.zeros(len(cols) + 1)
        coef[[i + 1 for i in used]] = final[k][1:] / scale
        coef[0] = final[k][0] - np.sum(final[k][1:] * mean / scale)
        out.append(coef)
    return out


def _packed(cols: list[str], mean: np.ndarray, scale: np.ndarray, most: int = 4096):
    """Rows of a fold in blocks of about ``most`` bytes: the class and ``cols`` centred and
    scaled, as doubles.  A batch of blocks stays small however wide the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(1, most // (8 * (len(cols) + 1)))
        for b in batches:
            m = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_kind", *cols)])
            m[:, 1:] = (m[:, 1:] - mean) / scale
            fold, folds, blocks = b.column("_fold").to_numpy(zero_copy_only=False), [], []
            for f in np.unique(fold):
                mine = m[fold == f]
                blocks += [mine[i : i + n].tobytes() for i in range(0, len(mine), n)]
                folds += [f] * (len(blocks) - len(folds))
            yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int64()), pa.array(blocks, pa.binary())], names=["_fold", "_rows"])

    return run


def _unpacked(b: pa.RecordBatch, width: int, most: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Fold, classes, and a column of ones beside the rows, for at most ``most`` rows at a time."""
    fold, blocks = b.column("_fold").to_numpy(), b.column("_rows")
    for f in np.unique(fold):
        m = np.concatenate([np.frombuffer(blocks[int(i)].as_buffer()) for i in np.flatnonzero(fold == f)]).reshape(-1, width)
        for i in range(0, len(m), most):
            z = m[i : i + most].copy()
            kind = z[:, 0].astype(int)
            z[:, 0] = 1
            yield int(f), kind, z


def _softmax_sums(due: list[tuple[int, bool, np.ndarray]]):
    """A part's loss, slope and curvature over the rows in a fold (or outside it) at given
    coefficients, a row of them for each class, for each of ``due``: one row a part."""

    def sums(z: np.ndarray, kind: np.ndarray, coef: np.ndarray) -> np.ndarray:
        d, at = z.shape[1], (np.arange(len(z)), kind)
        m = z @ coef.T
        m -= m.max(axis=1, keepdims=True)
        p = np.exp(m)
        whole = p.sum(axis=1)
        p /= whole[:, None]
        # a block of columns a class: what the classes share, then each one's own
        w = (p[:, :, None] * z[:, None, :]).reshape(len(z), -1)
        curve, own = -(w.T @ w), z.T @ w
        for j in range(0, w.shape[1], d):
            curve[j : j + d, j : j + d] += own[:, j : j + d]
        loss = np.sum(np.log(whole)) - np.sum(m[at])
        p[at] -= 1
        return np.concatenate([[loss], (p.T @ z).ravel(), curve.ravel()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(due), 1 + due[0][2].size + due[0][2].size ** 2))
        for b in batches:
            for f, kind, z in _unpacked(b, due[0][2].shape[1]):
                for i, (g, inside, coef) in enumerate(due):
                    if (f == g) == inside:
                        total[i] += sums(z, kind, coef)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _guesses(fits: np.ndarray):
    """How many of a part's rows have each fold, class and class guessed by their fold's fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = fits.shape[1], np.zeros((len(fits), fits.shape[1] ** 2))
        for b in batches:
            for f, kind, z in _unpacked(b, fits.shape[2]):
                total[f] += np.bincount(kind * n + np.argmax(z @ fits[f].T, axis=1), minlength=n * n)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _added(rows: DataFrame, run, n: int) -> np.ndarray:
    """The parts' ``n`` sums added up, so that the driver gets them once, not once a part."""
    got = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(n)
    out[[r["at"] for r in got]] = [r["v"] for r in got]
    return out


def fold_guesses(rows: DataFrame, cols: list[str], label: str, fold: str, k: int, penalty: float = 0.001, most: int = 50, near: float = 1e-10, share: int = 1 << 17) -> tuple[list[str], np.ndarray]:
    """The labels and, for each of ``k`` folds, how many rows of a label got each guess
    from multinomial logistic regression fitted on the other folds.

    Mean loss and half the penalty on the squared coefficients of columns standardised over
    the fit's rows, as in ``pyspark.ml`` (with two labels, as its binomial fits), all by
    Newton's method.  A pass gives each part's sums, whatever its rows; no row is kept in
    memory.  Steps on all rows come first: what is left out of a fit is one fold, so sums by
    fold at one place serve every fit, and their optima are near.  From there each fit
    takes its own steps, all in one pass, until it has converged.  Of many rows a share
    first gives where to start; only steps over all rows count.  ``rows`` is read twice,
    then written in blocks, which the steps read.  A column that doesn't vary in a fit has
    coefficient 0 there, and a label that a fit has not seen is not guessed.
    """
    places = range(len(cols))
    of = {f"{g}{i}": f(c).alias(f"{g}{i}") for i, c in enumerate(cols) for g, f in (("m", F.avg), ("v", F.var_pop), ("l", F.min), ("h", F.max))}
    seen = rows.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n"), *of.values()).collect()
    labels = sorted({r[label] for r in seen})
    if not seen:
        return labels, np.zeros((k, 0, 0))
    kinds, d = len(labels), len(cols) + 1
    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1
    x = rows.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(fold).cast("long").alias("_fold"), number.cast("int").alias("_kind"))

    def measures(part: list) -> tuple[np.ndarray, ...]:
        """Rows a label, and mean, spread and whether it varies of each column."""
        count, n, get = np.zeros(kinds), np.array([r["n"] for r in part], dtype=float), lambda g: np.array([[r[f"{g}{i}"] for i in places] for r in part], dtype=float).reshape(len(part), len(cols))
        for r in part:
            count[labels.index(r[label])] += r["n"]
        mean = n @ get("m") / n.sum()
        spread = np.sqrt(n @ (get("v") + (get("m") - mean) ** 2) / max(n.sum() - 1, 1))
        return count, mean, spread, (get("l").min(axis=0) < get("h").max(axis=0)) & (spread > 0)

    count, mean, spread, varies = measures(seen)
    scale, size = np.where(varies, spread, 1.0), kinds * d
    x = stored(x.mapInArrow(_packed(cols, mean, scale), "_fold long, _rows binary"))

    class Fit:
        """Where a fit is: its last coefficients, their loss, and those to try."""

        def __init__(self, part: list):
            self.count, _, own, moves = measures(part)
            # two softmax rows of opposite sign carry half the penalty of one row
            self.ridge = np.tile([0.0, *(penalty * (2 if kinds == 2 else 1) * (own / scale) ** 2)], (kinds, 1)).ravel()
            self.free = np.outer(self.count > 0, [True, *moves]).ravel()
            self.n, self.last, self.lowest, self.left = self.count.sum(), None, np.inf, np.inf
            self.now = np.zeros((kinds, d))
            self.now[:, 0] = np.where(self.count > 0, np.log(np.maximum(self.count, 1) / self.n), -1e9)
            self.now = self.now.ravel()

        def step(self, sums: np.ndarray) -> None:
            loss, slope, curve = sums[0] / self.n, sums[1 : size + 1] / self.n, sums[size + 1 :].reshape(size, size) / self.n
            loss += 0.5 * self.now[self.free] ** 2 @ self.ridge[self.free]
            if loss > self.lowest + 1e-12:  # too far
                self.now = (self.last + self.now) / 2
                return
            go, free = np.zeros(size), self.free
            slope = slope + self.ridge * self.now
            go[free] = np.linalg.lstsq((curve + np.diag(self.ridge))[np.ix_(free, free)], slope[free], rcond=None)[0]
            self.last, self.lowest, self.left, self.now = self.now, loss, slope[free] @ go[free], self.now - go

    def sums(of_rows: DataFrame, due: list[tuple[int, bool, np.ndarray]]) -> np.ndarray:
        run = _softmax_sums([(f, inside, at.reshape(kinds, d)) for f, inside, at in due])
        return _added(of_rows, run, len(due) * (1 + size + size * size)).reshape(len(due), -1)

    def together(of_rows: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray] | None:
        """Steps of a fit on all folds until the next is small; where it took that and the sums by fold there."""
        for _ in range(most):
            at, got = fit.now, sums(of_rows, [(f, True, fit.now) for f in range(k)])
            fit.step(got.sum(axis=0))
            if fit.last is at and fit.left <= near * 1e4:
                return at, got
        return None

    every, fits = Fit(seen), {f: Fit(part) for f in range(k) if (part := [r for r in seen if r[fold] != f])}
    shared = [f for f, fit in fits.items() if (fit.free == every.free).all()]
    if shared and every.n > 2 * share and count.min() * share >= 100 * every.n:
        some, first = stored(x.where(F.pmod(F.xxhash64("_rows"), F.lit(int(every.n // share))) == 0)), Fit(seen)
        first.n = some.agg(F.sum(F.octet_length("_rows"))).first()[0] / (8 * d)
        if together(some, first):
            every.now = first.now
    if shared and (met := together(x, every)):
        for f in shared:
            fits[f].now = met[0]
            fits[f].step(met[1].sum(axis=0) - met[1][f])
    for _ in range(most):
        due = {f: fit for f, fit in fits.items() if fit.left > near}
        if not due:
            break
        for fit, got in zip(due.values(), sums(x, [(f, False, fit.now) for f, fit in due.items()]), strict=True):
            fit.step(got)
    at = np.array([fits[f].now if f in fits else np.zeros(size) for f in range(k)]).reshape(k, kinds, d)
    return labels, _added(x, _guesses(at), k * kinds * kinds).reshape(k, kinds, kinds)


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, precision, recall, f1 of boolean columns."""
    y, p = F.col(label), F.col(prediction)
    x = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    x = x.withColumn("accuracy", ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"))).withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    return x.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"))).select(*[F.round(m, 4).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees on samples of at most ``sample`` rows each, built in parallel; the
    model is ``trees * sample`` rows at most, whatever the size of the input."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 42, whole_n: bool = True):
        self.trees, self.sample, self.seed, self.whole_n = trees, sample, seed, whole_n

    def fit(self, df: DataFrame, cols: list[str], key: str) -> IsolationForest:
        n = df.count()
        self.cols, self.norm = cols, _average_path(n if self.whole_n else min(n, self.sample)) or 1.0
        seed, most, names = self.seed, self.sample, cols
        # Each row draws its place in each tree by hash; about twice the sample's
        # rows are drawn and the tree keeps the smallest hashes among them.
        share = min(1.0, 2.0 * most / max(n, 1))
        draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(1 << 30)) / float(1 << 30)
        tree = F.explode(F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: draw(t) < share))
        drawn = df.select(key, *cols, tree.alias("tree")).withColumn("draw", draw(F.col("tree")))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["draw", key]).head(most)
            x = pdf[names].to_numpy(dtype=float)
            rng = np.random.default_rng([seed, int(pdf["tree"].iloc[0])])
            limit = math.ceil(math.log2(max(len(x), 2)))
            nodes: list[list] = []

            def grow(rows: np.ndarray, depth: int) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, -1, -1, depth + _average_path(len(rows))])
                lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
                open_cols = np.flatnonzero(hi > lo)
                if depth < limit and len(rows) > 1 and len(open_cols):
                    c = int(rng.choice(open_cols))
                    cut = float(rng.uniform(lo[c], hi[c]))
                    left = rows[:, c] < cut
                    nodes[at][:4] = [c, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)]
                return at

            grow(x, 0)
            out = pd.DataFrame(nodes, columns=["col", "cut", "left", "right", "path"])
            return out.assign(tree=int(pdf["tree"].iloc[0]), node=range(len(out)))

        rows = drawn.groupBy("tree").applyInPandas(build, "tree int, node int, col int, cut double, left int, right int, path double")
        made = rows.orderBy("tree", "node").toPandas()
        self.model = [g[["col", "cut", "left", "right", "path"]].to_numpy() for _, g in made.groupby("tree")]
        return self

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """``2 ** (-mean path / c(n))`` in [0, 1]; higher is more isolated."""
        # a leaf leads to itself, so all rows take as many steps as the tree is deep
        walks = []
        for t in self.model:
            leaf, own = t[:, 0] < 0, np.arange(len(t))
            kids = np.column_stack([np.where(leaf, own, t[:, 3]), np.where(leaf, own, t[:, 2])]).astype(np.int64).ravel()
            depth, at = 0, np.zeros(1, dtype=np.int64)
            while not leaf[at].all():
                at, depth = np.unique(np.concatenate([kids[2 * at], kids[2 * at + 1]])), depth + 1
            walks.append((np.where(leaf, 0, t[:, 0]).astype(np.int64), t[:, 1].copy(), kids, t[:, 4].copy(), depth))
        held, norm, cols = df.sparkSession.sparkContext.broadcast(walks), self.norm, self.cols

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.column_stack([s.to_numpy(dtype=float) for s in batch])
                total, flat, row = np.zeros(len(x)), x.ravel(), np.arange(len(x)) * x.shape[1]
                for col, cut, kids, path, depth in held.value:
                    at = np.zeros(len(x), dtype=np.int64)
                    for _ in range(depth):
                        at = kids.take(2 * at + (flat.take(row + col.take(at)) < cut.take(at)))
                    total += path.take(at)
                yield pd.Series(2.0 ** (-total / max(len(held.value), 1) / norm))

        return df.withColumn(name, run(*[F.col(c).cast("double") for c in cols]))


def flow_anomalies(flows: DataFrame, trees: int = 30, cut: float = 0.65, least: int = 20, top: int | None = 50) -> DataFrame:
    """Flows that an isolation forest over five log features sets apart."""
    cols = ["b", "p", "d", "port", "rate"]
    x = flows.select(
        "flow_id", "src_ip", "dst_ip", F.log1p("total_bytes").alias("b"), F.log1p("packet_count").alias("p"), F.log1p("session_duration").alias("d"), F.log1p("dst_port").alias("port"),
        F.log1p(F.col("total_bytes") / F.greatest(F.col("packet_count"), F.lit(1))).alias("rate"),
    )
    if x.limit(least).count() < least:
        return x.select("flow_id", "src_ip", "dst_ip", F.lit(0.0).alias("score")).limit(0)
    s = IsolationForest(trees).fit(x, cols, "flow_id").score(x, "score").where(F.col("score") >= cut).select("flow_id", "src_ip", "dst_ip", F.round("score", 4).alias("score"))
    return s if top is None else s.orderBy(F.desc("score"), "flow_id").limit(top)
