"""Near copies among embeddings by an inverted multi-index, verified exactly.

Vectors of equal label (not null) and length are linked if their cosine, in double
precision, reaches ``THRESHOLD``.

1. *Classes.*  Equal vectors of a label are one class with a count.
2. *Codebooks.*  K-means of the left and of the right halves of the unit vectors, each on
   its own, on a sample by hash of at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``; the
   codes grow with the largest label.  A pair of codes is a cell of the product grid.
   Vectors of a length that the sample doesn't hold have one cell.
3. *Traversal.*  Each class is filed in its own cell and visits others by the
   multi-sequence algorithm, nearest first, until the cells of ``TARGET_RECALL`` of
   neighbours at the very threshold have been met: how much farther than its own cell
   those lie is measured on the sample.  Of two cells the lower one's vectors visit, so
   a pair meets once.
4. *Verification.*  A cell's vectors are compared exactly.  A cell of more than ``BLOCK``
   vectors is dealt into blocks, each covered by balls so small that all within one are
   linked.  By the triangle inequality for angles most pairs of balls are linked whole or
   not at all; those, and pairs of single vectors, are settled by the centres.  The
   vectors of the other pairs are compared on tasks of their own.
5. *Components* over one row a vector and unit of work, never one a pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers,
and rows without a label, have no links and are kept.  Repeated rows count as copies.  A
component's id is its least vec_id that isn't null; without one it is null.  Extra
columns are ignored; an empty table gives no rows.  Links lost by the index are those
beyond the target recall; none below the threshold is given.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.components import connected_components

THRESHOLD, TARGET_RECALL = 0.93, 0.99
#: Vectors of the sample and their bytes; vectors a cell should hold; codes of a half.
SAMPLE, SAMPLE_BYTES, CELL, LEAST_CODES, MOST_CODES = 65_536, 64 << 20, 32, 8, 1024
#: Vectors of a unit of work, and copies of a row that many rows are joined with.
BLOCK, SALTS = 4096, 16
#: Angles are trusted to this many radians.
_SLACK = 1e-6


def units(vectors: list[np.ndarray]) -> np.ndarray:
    """Unit vectors in double precision; large and tiny components don't overflow."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# --- codebooks


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    size = (codes * codes).sum(axis=1)
    return np.concatenate([(size - 2 * (x[a : a + 4096] @ codes.T)).argmin(axis=1) for a in range(0, len(x), 4096)])


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    codes = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, codes)
        n = np.bincount(at, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, at, x)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


class Grid:
    """The codebooks of one vector length."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        self.half = sample.shape[1] // 2
        self.left, self.right = _k_means(sample[:, : self.half], k), _k_means(sample[:, self.half :], k)
        # neighbours at the threshold in random directions: how far are their cells?
        rng = np.random.default_rng(11)
        x = sample[rng.permutation(len(sample))[:4096]]
        aside = rng.standard_normal(x.shape)
        aside -= (aside * x).sum(axis=1, keepdims=True) * x
        norm = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        y = threshold * x + math.sqrt(1 - threshold**2) * aside / np.where(norm > 0, norm, 1)
        a, b = self.distances(x)
        every = np.arange(len(x))
        beyond = a[every, _nearest(y[:, : self.half], self.left)] + b[every, _nearest(y[:, self.half :], self.right)] - a.min(axis=1) - b.min(axis=1)
        self.margin = float(np.quantile(beyond, recall, method="higher")) + 1e-9

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves from the codes."""

        def far(h, codes):
            return (h * h).sum(axis=1, keepdims=True) - 2 * (h @ codes.T) + (codes * codes).sum(axis=1)

        return far(x[:, : self.half], self.left), far(x[:, self.half :], self.right)

    def cells(self, x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Each vector's own cell and the later cells that it visits."""
        k = len(self.right)
        for a in range(0, len(x), 1024):
            for left, right in zip(*self.distances(x[a : a + 1024]), strict=True):
                i, j = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
                home = int(i[0]) * k + int(j[0])
                yield home, [c for c in traverse(left[i].tolist(), right[j].tolist(), i.tolist(), j.tolist(), self.margin) if c > home]


def traverse(left: list[float], right: list[float], i: list[int], j: list[int], margin: float) -> Iterator[int]:
    """Multi-sequence algorithm: cells in order of the sum of their halves' sorted
    distances, until it passes the first cell's by ``margin``."""
    k, end = len(j), left[0] + right[0] + margin
    heap, done = [(left[0] + right[0], 0, 0)], [0] * len(i)  # done: columns of a row that have come out
    while heap and heap[0][0] <= end:
        _, r, c = heapq.heappop(heap)
        yield i[r] * k + j[c]
        done[r] = c + 1
        if r + 1 < len(i) and done[r + 1] == c:
            heapq.heappush(heap, (left[r + 1] + right[c], r + 1, c))
        if c + 1 < k and (r == 0 or done[r - 1] > c + 1):
            heapq.heappush(heap, (left[r] + right[c + 1], r, c + 1))


# --- units of work


def components(linked: np.ndarray) -> np.ndarray:
    """Least vertex that each vertex of a symmetric matrix reaches."""
    root = np.full(len(linked), -1)
    for v in range(len(linked)):
        if root[v] < 0:
            root[v], front = v, np.array([v])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = v
    return root


def compare(x: np.ndarray, member: np.ndarray, side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which vectors are linked: members with each other and with visitors; between the
    two sides only, if there are sides."""
    linked = np.zeros((len(x), len(x)), dtype=bool)
    for a in range(0, len(x), 1024):
        linked[a : a + 1024] = x[a : a + 1024] @ x.T >= threshold
    linked &= member[:, None] | member[None, :]
    if side is not None:
        linked &= side[:, None] != side[None, :]
    linked |= linked.T  # products may differ in the last bit
    np.fill_diagonal(linked, False)
    return linked


def cover(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's ball, named by its centre's position, and its angle from there."""
    ball, angle = np.full(len(x), -1), np.zeros(len(x))
    left = np.arange(len(x))
    while len(left):
        far = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1))
        far[0] = 0.0
        near = far <= radius
        ball[left[near]], angle[left[near]] = left[0], far[near]
        left = left[~near]
    return ball, angle


_FOUND = "cls long, links long, root long"


def _found(cls: np.ndarray, copies: np.ndarray, linked: np.ndarray) -> list[tuple[int, int, int]]:
    links, root = linked @ copies, components(linked)
    return [(int(cls[v]), int(links[v]), int(cls[root[v]])) for v in np.flatnonzero(linked.any(axis=1))]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of equal keys as columns; vectors as arrays.  A run is bounded by the caller."""

    def rows():
        for batch in batches:
            names = batch.schema.names
            columns = [[np.asarray(v.values) for v in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for r in zip(*columns, strict=True):
                yield dict(zip(names, r, strict=True))

    for key, run in itertools.groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
        run = [*run]
        yield key, {name: [r[name] for r in run] for name in run[0]}


def _in_found(units_of: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    for rows in units_of:
        yield _batch(rows, ["cls", "links", "root"], [pa.int64()] * 3)


def _cells(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for _, u in _runs(batches, "label", "dim", "cell"):
                linked = compare(units(u["embedding"]), np.array(u["member"]), None, threshold)
                yield _found(np.array(u["cls"]), np.array(u["copies"]), linked)

        yield from _in_found(out())

    return run


_BALLS = "label string, dim int, cell long, nb int, block int, member boolean, ball long, cls long, copies long, angle double, embedding array<double>"
_BALL_NAMES = [f.split()[0] for f in _BALLS.split(", ")]
_BALL_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]


def _cover(threshold: float):
    """Blocks of large cells as balls of members and balls of visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, u in _runs(batches, "label", "dim", "cell", "nb", "block", "member"):
            x = units(u["embedding"])
            ball, angle = cover(x, math.acos(threshold) / 2 - _SLACK)
            rows = [(*key, u["cls"][b], u["cls"][v], u["copies"][v], a, x[v]) for v, (b, a) in enumerate(zip(ball.tolist(), angle.tolist(), strict=True))]
            for a in range(0, len(rows), 1024):
                yield _batch(rows[a : a + 1024], _BALL_NAMES, _BALL_TYPES)

    return run


def _ball_pairs(threshold: float):
    """Two blocks' balls: links of balls that are linked whole, and undecided pairs."""
    limit = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*_, bi, bj), u in _runs(batches, "label", "dim", "cell", "bi", "bj"):
            x, no, member = np.stack(u["centre"]), np.array(u["no"]), np.array(u["member"])
            copies, radius, alone = np.array(u["copies"]), np.array(u["radius"]), np.array(u["m"]) == 1
            block = np.array(u["block"])
            cosine = x @ x.T
            angle = np.arccos(np.clip(cosine, -1, 1))
            reach = radius[:, None] + radius[None, :]
            due = (member[:, None] | member[None, :]) & ~np.eye(len(x), dtype=bool)
            if bi != bj:
                due &= block[:, None] != block[None, :]
            single = alone[:, None] & alone[None, :]
            linked = due & np.where(single, cosine >= threshold, angle + reach <= limit - _SLACK)
            open_ = due & ~linked & ~single & (angle - reach <= limit + _SLACK)
            linked, open_ = linked | linked.T, open_ | open_.T
            open_ &= ~linked
            out = [(b, n, r, None) for b, n, r in _found(no, copies, linked)]
            i, j = np.nonzero(np.triu(open_))
            out += [(a, None, None, b) for a, b in zip(no[i].tolist(), no[j].tolist(), strict=True)]
            for a in range(0, len(out), 65_536):
                yield _batch(out[a : a + 65_536], ["ball", "links", "root", "other"], [pa.int64()] * 4)

    return run


def _open_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for (a, _), u in _runs(batches, "a", "b"):
                every = np.ones(len(u["cls"]), dtype=bool)
                linked = compare(np.stack(u["embedding"]), every, np.array(u["no"]) == a, threshold)
                yield _found(np.array(u["cls"]), np.array(u["copies"]), linked)

        yield from _in_found(out())

    return run


def _large(work: DataFrame, threshold: float) -> DataFrame:
    """Links in cells of more than a block: ``cls, links, root``."""
    at = ["label", "dim", "cell"]
    dealt = work.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")).repartition(*at, "block")
    by = [*at, "nb", "block", "member"]
    covered = written(dealt.sortWithinPartitions(*by, "cls").mapInArrow(_cover(threshold), _BALLS))
    sums = covered.groupBy(*by, "ball").agg(F.count(F.lit(1)).alias("m"), F.sum("copies").alias("copies"), F.max("angle").alias("radius"))
    centres = covered.where("cls = ball").select(*by, "ball", F.col("embedding").alias("centre"))
    balls = written(sums.join(centres, [*by, "ball"]).withColumn("no", F.monotonically_increasing_id()))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    halves = balls.select("*", other).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    keys = [*at, "bi", "bj"]
    judged = written(halves.repartition(*keys).sortWithinPartitions(*keys, "no").mapInArrow(_ball_pairs(threshold), "ball long, links long, root long, other long"))

    names = balls.select(*by, "ball", "no", F.col("copies").alias("ball_copies"))
    inside = written(covered.join(names, [*by, "ball"]).select("no", "member", "ball", "cls", "copies", "ball_copies", "embedding"))
    whole = judged.where("other is null")
    bulk = whole.groupBy("ball").agg(F.sum("links").alias("links")).withColumnRenamed("ball", "no")
    of_ball = inside.select("no", "member", "ball", "cls", "copies", "ball_copies").join(bulk, "no", "left")
    links = F.coalesce("links", F.lit(0)) + F.when(F.col("member"), F.col("ball_copies") - F.col("copies")).otherwise(0)
    # all vectors of a ball are linked with its centre, or with whatever the ball is linked with
    each = of_ball.select("cls", links.alias("links"), F.col("ball").alias("root")).where("links > 0")
    centre = lambda c: names.select(F.col("no").alias(c), F.col("ball").alias(f"{c}_cls"))
    joined = whole.join(centre("ball"), "ball").join(centre("root"), "root").select(F.col("ball_cls").alias("cls"), F.lit(0).cast("long").alias("links"), F.col("root_cls").alias("root"))
    pairs = judged.where("other is not null").select(F.col("ball").alias("a"), F.col("other").alias("b"))
    both = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("no")).join(inside, "no").select("a", "b", "no", "cls", "copies", "embedding")
    rest = both.repartition("a", "b").sortWithinPartitions("a", "b", "no", "cls").mapInArrow(_open_pairs(threshold), _FOUND)
    return each.unionByName(joined).unionByName(rest)


# --- the operator


def _usable(vector: Column, label: Column) -> Column:
    number = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~bad & F.exists(vector, lambda x: number(x) != 0), F.lit(False))


def grids(classes: DataFrame, threshold: float, recall: float, codes: int | None = None) -> dict[int, Grid]:
    """Codebooks by vector length, fitted on a bounded sample by hash."""
    size = classes.groupBy("label", "dim").count().agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max("dim").alias("dim")).first()
    if not size.n:
        return {}
    k = codes or min(MOST_CODES, max(LEAST_CODES, math.ceil(math.sqrt(size.most / CELL))))
    share = min(1.0, SAMPLE / size.n, SAMPLE_BYTES / (8 * size.dim * size.n))
    drawn = classes.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").toArrow()
    by_length: dict[int, list[np.ndarray]] = {}
    for v in drawn.column("embedding"):
        by_length.setdefault(len(v), []).append(np.asarray(v.values))
    return {d: Grid(units(x), min(k, len(x)), threshold, recall) for d, x in by_length.items() if d > 1}


def _place(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dim", "cell", "member", "cls", "copies"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("label", "dim", "cls", "copies")}
            vectors = [np.asarray(v.values) for v in batch.column("embedding")]
            for dim in sorted({*columns["dim"]}):
                mine = [i for i, d in enumerate(columns["dim"]) if d == dim]
                grid = held.value.get(dim)
                cells = grid.cells(units([vectors[i] for i in mine])) if grid else itertools.repeat((0, []), len(mine))
                out = []
                for i, (home, visits) in zip(mine, cells, strict=True):
                    for cell in (home, *visits):
                        out.append((columns["label"][i], dim, cell, cell == home, columns["cls"][i], columns["copies"][i]))
                yield _batch(out, names, types)

    return run


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, codes: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row a vector: ``id_col``, n_links (other vectors linked with it),
    component_id (least id that it reaches) and kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    usable = _usable(F.col("embedding"), F.col("label"))
    good = rows.where(usable)
    classes = good.groupBy("label", "embedding").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("cls")))

    held = vectors.sparkSession.sparkContext.broadcast(grids(classes, threshold, target_recall, codes))
    at = ["label", "dim", "cell"]
    placed = written(classes.select("label", "dim", "cls", "copies", "embedding").mapInArrow(_place(held), "label string, dim int, cell long, member boolean, cls long, copies long"))
    cells = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("m"), F.max("member").alias("has")).where("has and m > 1")
    # a cell's row is copied, so that the many vectors of one cell meet it on several tasks
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    sized = cells.select(*at, F.ceil(F.col("m") / block).cast("int").alias("nb"), salts)
    due = placed.select("*", salt("cls")).join(sized, [*at, "salt"]).select(*at, "member", "cls", "copies", "nb")
    work = written(due.join(classes.select("cls", "embedding").hint("merge"), "cls"))
    small = work.where("nb = 1").repartition(*at).sortWithinPartitions(*at, "cls").mapInArrow(_cells(threshold), _FOUND)
    large = work.where("nb > 1")
    found = written(small if large.isEmpty() else small.unionByName(_large(large, threshold)))
    held.unpersist()

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    spread = connected_components(found.select(F.col("cls").alias("src"), F.col("root").alias("dst")))
    linked = spread.withColumnRenamed("node", "cls").join(classes.select("cls", "first").hint("merge"), "cls")
    heads = linked.groupBy("component").agg(F.min("first").alias("head")).select("component", "head", salts)
    named = linked.select("cls", "component", salt("cls")).join(heads, ["component", "salt"]).select("cls", "head", F.lit(True).alias("linked"))
    more = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    head = F.when(F.col("linked"), F.col("head")).otherwise(F.col("first"))
    known = classes.join(links.hint("merge"), "cls", "left").join(named.hint("merge"), "cls", "left")
    known = written(known.select("label", "embedding", "copies", "first", more.cast("long").alias("n_links"), head.alias("component_id")))

    # a class of one vector is its row; copies find their class by the vector
    out = [F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")]
    alone = known.where("copies = 1").withColumnRenamed("first", "id").select(*out)
    several = known.where("copies > 1").select("label", "embedding", "n_links", "component_id", salts)
    copied = good.select("*", salt("id")).join(several, ["label", "embedding", "salt"]).select(*out)
    apart = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).select(*out)
    return alone.unionByName(copied).unionByName(apart)
