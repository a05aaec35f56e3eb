"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

A text is the set of its 5-word shingles (words are runs of non-white-space; a
text of one to four words is one shingle).  Two texts are linked if the Jaccard
similarity of their sets is at least 0.8.

1. *Classes.*  Documents with equal sets are one class.
2. *Forest.*  A class has a signature of ``trees`` labels of ``max_depth`` MinHash
   values each; tree by tree the labels, in order, are a prefix trie.  Classes that
   share no prefix of the least depth with any other are done.
3. *Descent.*  In each trie node of the least depth every class is held against the
   node's least class: how long a prefix do their labels share in any tree?  From the
   full depth on the matched prefix is shortened, step by step, until the share of
   these pairs that meet reaches ``target_recall``.  The least depth is the one at
   which even two texts at the very threshold meet with that probability.
4. *Groups.*  At the depth found, the classes below one trie node are linked to the
   node's least class only; connected components of those links are groups.
5. *Verification.*  In a group any two classes are compared exactly.  A small group is
   one unit of work on some task.  A large one is dealt into hashed blocks; its texts
   are compared with one of them once and from then on stand for their differences
   from it, a few shingles for near copies, and each pair of blocks is a unit.  A unit
   counts the links of each class and joins linked classes by union-find; it returns
   one row per class, not one per pair.  Blocks grow with their group, so that texts
   are dealt to at most 32 units up to 262,144 different near copies.

Defined results: texts without words have no shingles, form one class and no links;
documents without an id take part (a class's id is the least of its documents', null
if none has one); different texts under one id are different classes; repeated rows
count as copies; extra columns are ignored.  Nothing is capped, cut or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 40, 12, 0.9999
#: Classes of a block, and shingles of all its classes.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
SALTS = 16
MAX_WORDS_HELD = 500_000
#: Bits of a MinHash value below the least depth.
_BITS = 12

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int = WORDS):
        self.n, self.words = n, {}
        self.scale = _mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        held = self.words
        new = set(words).difference(held)
        if new:
            if len(held) + len(new) > MAX_WORDS_HELD:
                held.clear()
                new = set(words)
            for w in new:
                held[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(held.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, len(h) if len(h) < self.n else 0, dtype=np.uint64)
        for j in range(n):
            out += h[j : len(h) - n + 1 + j] * self.scale[j]
        return np.unique(_mix(out))


def least_depth(threshold: float, trees: int, max_depth: int, target_recall: float) -> int:
    """The longest prefix with which texts at ``threshold`` meet in one of
    ``trees`` tries with probability ``target_recall``."""
    for depth in range(max_depth, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= target_recall:
            return depth
    raise ValueError("no prefix reaches this recall with so few trees")


def descend(met: dict[int, int], least: int, max_depth: int, target_recall: float) -> int:
    """The depth to which a matched prefix has to be shortened: ``met`` counts pairs by
    the longest prefix that they share; all that share the least one are to be found."""
    whole, found = sum(met.values()), 0
    for depth in range(max_depth, least, -1):
        found += met.get(depth, 0)
        if found >= target_recall * whole:
            return depth
    return least


class Signature:
    """MinHash values of a set: ``bins`` values, each equal for two sets with the
    probability of their similarity.

    Every element is thrown into a random bin, round after round, until no bin is
    empty; a bin keeps the least of (round, hash).  That takes time in proportion to
    the elements and bins together, not to their product."""

    TOP = np.uint64((1 << 64) - 1)

    def __init__(self, bins: int):
        self.bins = bins

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        bins, n, first = self.bins, len(shingles), 0
        out = np.full(bins, self.TOP)
        throws = bins * (np.log(bins) + 2)
        while True:
            per = max(1, int(np.ceil(throws / n)))
            rounds = np.arange(first, first + per, dtype=np.uint64)
            h = _mix(shingles[None, :] + (rounds * _GOLD)[:, None])
            bin_of = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            late = rounds >= bins  # from here on each round fills one bin
            bin_of[late] = (rounds[late] % np.uint64(bins))[:, None]
            np.minimum.at(out, bin_of.ravel().astype(np.int64), ((rounds << np.uint64(32))[:, None] | (h & np.uint64(0xFFFFFFFF))).ravel())
            first += per
            if out.max() != self.TOP:
                return _mix(out)
            throws = bins


class Forest:
    """Where a set is filed in each tree: the trie node of the least depth, and the
    values below it, in order, packed into one number."""

    def __init__(self, trees: int, max_depth: int, least: int):
        if (max_depth - least) * _BITS > 63:
            raise ValueError("too many depths below the least one")
        self.trees, self.max_depth, self.least = trees, max_depth, least
        self.signature = Signature(trees * max_depth)
        self.roots = _mix(np.arange(1, trees + 1, dtype=np.uint64) * _GOLD)

    def file(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = self.signature(shingles).reshape(self.trees, self.max_depth)
        node, below = self.roots.copy(), np.zeros(self.trees, dtype=np.uint64)
        for j in range(self.least):
            node = _mix(node * _GOLD + label[:, j])
        for j in range(self.least, self.max_depth):
            below = (below << np.uint64(_BITS)) | (label[:, j] >> np.uint64(64 - _BITS))
        return node.view(np.int64), below.view(np.int64)


@dataclass
class Text:
    """A class in a unit of work: its shingles themselves, or (``relative``) its
    differences from a text of ``base`` shingles that all relative ones share."""

    cls: int
    n: int
    plus: np.ndarray
    minus: np.ndarray
    relative: bool = False
    base: int = 0
    common: int = 0  # shingles that it has in common with that text


_NONE = np.empty(0, dtype=np.uint64)


def relative_to(pivot: np.ndarray, cls: int, shingles: np.ndarray) -> Text:
    plus = np.setdiff1d(shingles, pivot, assume_unique=True)
    minus = np.setdiff1d(pivot, shingles, assume_unique=True)
    common = len(shingles) - len(plus)
    if len(plus) + len(minus) < len(shingles):
        return Text(cls, len(shingles), plus, minus, True, len(pivot), common)
    return Text(cls, len(shingles), shingles, _NONE, False, len(pivot), common)


def compare(left: list[Text], right: list[Text] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Linked pairs (i, j, similarity) between ``left`` and ``right`` (None: within
    ``left``, i < j), a strip at a time.

    Overlaps are products of matrices over the shingles that two texts share, with
    -1 for a shingle that a relative text lacks: relative texts overlap in
    base - lacks - lacks + product, a relative and another one in common + product."""
    texts = left + (right or [])
    first = len(left)
    every = np.concatenate([x for t in texts for x in (t.plus, t.minus)])
    sign = np.concatenate([np.full(len(x), v, dtype=np.float32) for t in texts for x, v in ((t.plus, 1), (t.minus, -1))])
    owner = np.repeat(np.arange(len(texts)), [len(t.plus) + len(t.minus) for t in texts])
    _, column, seen = np.unique(every, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    rank = np.cumsum(seen > 1) - 1
    owner, column, sign = owner[shared], rank[column[shared]], sign[shared]
    order = np.argsort(column, kind="stable")
    owner, column, sign = owner[order], column[order], sign[order]
    n_columns = int((seen > 1).sum())
    n = np.array([t.n for t in texts], dtype=np.int64)
    rel = np.array([t.relative for t in texts])
    lacks = np.array([len(t.minus) for t in texts], dtype=np.int64)
    common = np.array([t.common for t in texts], dtype=np.int64)
    base = max(t.base for t in texts)
    to = np.arange(first, len(texts)) if right is not None else np.arange(first)
    t = round(threshold * 1000)
    for a in range(0, first, 1024):
        rows = np.arange(a, min(a + 1024, first))
        both = np.zeros((len(rows), len(to)), dtype=np.float32)
        for c in range(0, n_columns, 1024):
            lo, hi = np.searchsorted(column, [c, c + 1024])
            m = np.zeros((len(texts), min(1024, n_columns - c)), dtype=np.float32)
            m[owner[lo:hi], column[lo:hi] - c] = sign[lo:hi]
            both += m[rows] @ m[to].T
        both = np.rint(both).astype(np.int64)
        r, s = rel[rows][:, None], rel[to][None, :]
        both += np.where(r & s, base - lacks[rows][:, None] - lacks[to][None, :], 0)
        both += np.where(r & ~s, common[to][None, :], 0) + np.where(~r & s, common[rows][:, None], 0)
        sizes = n[rows][:, None] + n[to][None, :]
        linked = both * (1000 + t) >= t * sizes  # in thousandths, so exact
        if right is None:
            linked &= rows[:, None] < to[None, :]
        i, j = np.nonzero(linked)
        got = both[i, j]
        yield rows[i], to[j], got / (sizes[i, j] - got)


def _joined(n: int, i: np.ndarray, j: np.ndarray, root: list[int]) -> None:
    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    for x in range(n):
        root[x] = find(x)


def unit(left: list[Text], right: list[Text] | None, threshold: float) -> list[tuple[int, int, int]]:
    """A row (cls, links, least class linked to it) for each class of a unit of work."""
    texts = sorted(left, key=lambda t: t.cls) + sorted(right or [], key=lambda t: t.cls)
    cls = np.array([t.cls for t in texts], dtype=np.int64)
    by = np.argsort(cls, kind="stable")  # union-find over classes in order: a root is the least
    rank = np.empty(len(cls), dtype=np.int64)
    rank[by] = np.arange(len(cls))
    links, root = np.zeros(len(cls), dtype=np.int64), [*range(len(cls))]
    for i, j, _ in compare(texts[: len(left)], texts[len(left) :] if right is not None else None, threshold):
        links += np.bincount(i, minlength=len(cls)) + np.bincount(j, minlength=len(cls))
        _joined(len(cls), rank[i], rank[j], root)
    return [*zip(cls.tolist(), links.tolist(), cls[by[[root[r] for r in rank.tolist()]]].tolist(), strict=True)]


_FOUND = "cls long, links long, root long"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["cls", "links", "root"])


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows in runs of equal ``keys``; batches may cut a run."""
    from itertools import groupby

    def rows():
        for batch in batches:
            cols = [batch.column(c) for c in batch.schema.names]
            for i in range(batch.num_rows):
                yield {n: c[i] for n, c in zip(batch.schema.names, cols, strict=True)}

    return groupby(rows(), key=lambda r: tuple(r[k].as_py() for k in keys))


def _verify_small(texts: DataFrame, words: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, out = Shingler(words), []
        for _, rows in _runs(batches, ("grp",)):
            held = {}
            for r in rows:
                if (c := r["cls"].as_py()) not in held:  # rows repeated with id and text
                    s = shingle(r["text"].as_py())
                    held[c] = Text(c, len(s), s, _NONE)
            out += unit([*held.values()], None, threshold)
            if len(out) > 4096:
                yield _found(out)
                out = []
        yield _found(out)

    return texts.select("grp", "cls", "text").repartition("grp").sortWithinPartitions("grp", "cls").mapInArrow(run, _FOUND)


def _verify_large(texts: DataFrame, words: int, threshold: float) -> DataFrame:
    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)

        def out(rows):
            signed = lambda k: pa.array([x[k].view(np.int64) for x in rows], pa.list_(pa.int64()))
            plain = [pa.array([x[k] for x in rows], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.int32()))]
            more = [pa.array([x[k] for x in rows], t) for k, t in ((7, pa.bool_()), (8, pa.int32()), (9, pa.int32()))]
            return pa.RecordBatch.from_arrays([*plain, signed(5), signed(6), *more], ["grp", "nb", "block", "cls", "n", "plus", "minus", "relative", "base", "common"])

        for (grp, block), rows in _runs(batches, ("grp", "block")):
            pivot, made, last = None, [], None
            for r in rows:
                cls = r["cls"].as_py()
                if r["member"].as_py() and cls == last:
                    continue
                s = shingle(r["text"].as_py())
                if not r["member"].as_py():
                    pivot = s
                    continue
                last, t = cls, relative_to(pivot, cls, s)
                made.append((grp, r["nb"].as_py(), block, cls, t.n, t.plus, t.minus, t.relative, t.base, t.common))
                if len(made) == 256:
                    yield out(made)
                    made = []
            yield out(made)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bi, bj), rows in _runs(batches, ("grp", "bi", "bj")):
            blocks = {bi: [], bj: []}
            for r in rows:
                unsigned = lambda c: np.array(r[c].values, dtype=np.int64).view(np.uint64)  # noqa: B023,E731
                blocks[r["block"].as_py()].append(Text(*(r[c].as_py() for c in ("cls", "n")), unsigned("plus"), unsigned("minus"), *(r[c].as_py() for c in ("relative", "base", "common"))))
            if blocks[bi]:
                yield _found(unit(blocks[bi], None if bi == bj else blocks[bj], threshold))

    # the least class of a group goes to each of its blocks, before the block's own classes
    blocks = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    pivots = texts.where("cls = grp").dropDuplicates(["cls"]).withColumn("block", blocks).withColumn("member", F.lit(False))
    dealt = texts.withColumn("member", F.lit(True)).unionByName(pivots).repartition("grp", "block").sortWithinPartitions("grp", "block", "member", "cls")
    kept = "grp long, nb int, block int, cls long, n int, plus array<long>, minus array<long>, relative boolean, base int, common int"
    short = written(dealt.select("grp", "nb", "block", "member", "cls", "text").mapInArrow(differences, kept))
    units = short.withColumn("other", blocks).select(F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), *short.columns)
    return units.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "block", "cls").mapInArrow(pairs, _FOUND)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, target_recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: ``id_col``, class_id (least id with an equal shingle
    set), n_copies (documents of the class), n_links (other classes linked to it)
    and cluster_id (least id of its connected component of links)."""
    least = least_depth(threshold, trees, max_depth, target_recall)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, forest, empty = Shingler(words), Forest(trees, max_depth, least), np.empty(0, np.int64)
        for batch in batches:
            names, sizes, filed, held = [], [], [], {}
            for text in batch.column("text"):
                s = shingle(text.as_py())
                name = xxhash.xxh3_128_hexdigest(s.tobytes())
                if name not in held:
                    held[name] = forest.file(s) if len(s) else (empty, empty)
                names.append(name)
                sizes.append(len(s))
                filed.append(held[name])
            lists = [pa.array([x[k] for x in filed], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(names), pa.array(sizes, pa.int32()), *lists], ["id", "hash", "name", "n", "nodes", "below"])

    filed = written(rows.mapInArrow(file, "id long, hash long, name string, n int, nodes array<long>, below array<long>"))
    # one document stands for its class
    order = F.struct(F.col("id").isNull().alias("without"), "id", "hash")
    classes = filed.groupBy("name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    classes = written(classes.select("name", "n_copies", F.col("first.id").alias("class_id"), F.col("first.hash").alias("hash"), F.monotonically_increasing_id().alias("cls")))
    same = filed.id.eqNullSafe(classes.class_id) & (filed.hash == classes.hash) & (filed.name == classes.name)
    place = F.explode(F.arrays_zip("nodes", "below")).alias("x")
    first = filed.join(classes, same).select("cls", "n", place).select("cls", "n", F.col("x.nodes").alias("node"), F.col("x.below").alias("below"))
    low = first.groupBy("node").agg(F.min(F.struct("cls", "below")).alias("low"), F.max("cls").alias("high")).where("low.cls < high")
    live = written(first.join(low, "node").select("cls", "n", "node", "below", "low"))

    apart = F.col("below").bitwiseXOR(F.col("low.below"))
    shared = F.lit(least)
    for depth in range(least + 1, max_depth + 1):
        shared = F.when(apart < F.lit(1 << _BITS * (max_depth - depth)), F.lit(depth)).otherwise(shared)
    stars = written(live.where("cls > low.cls").groupBy(F.col("cls").alias("src"), F.col("low.cls").alias("dst")).agg(F.max(shared).alias("depth")))
    met = {r.depth: r["count"] for r in stars.groupBy("depth").count().collect()}  # a row for each depth
    depth = descend(met, least, max_depth, target_recall)
    if depth > least:
        keyed = live.select("cls", F.xxhash64("node", F.shiftright("below", _BITS * (max_depth - depth))).alias("key"))
        head = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("key", "low")
        stars = keyed.join(head, "key").where("cls > low").select(F.col("cls").alias("src"), F.col("low").alias("dst")).distinct()

    members = written(connected_components(stars).select(F.col("node").alias("cls"), F.col("component").alias("grp")).join(live.select("cls", "n").distinct(), "cls"))
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    per = F.greatest(F.lit(block), F.least(F.lit(8192), F.col("m") / 32))
    nb = F.greatest(F.ceil(F.col("m") / per), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    placed = members.select("cls", "grp").join(sizes.select("grp", nb.alias("nb")), "grp").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    by_text = rows.id.eqNullSafe(classes.class_id) & (rows.hash == classes.hash)
    # candidates grow with the data, so they are never broadcast: one plan at every size
    work = written(rows.join(classes.join(placed, "cls").hint("merge"), by_text).select("grp", "nb", "block", "cls", "text"))
    one = _verify_small(work.where("nb = 1"), words, threshold).withColumn("whole", F.lit(True))
    many = _verify_large(work.where("nb > 1"), words, threshold).withColumn("whole", F.lit(False))
    found = written(one.unionByName(many).where("links > 0"))

    counted = found.groupBy("cls").agg(F.sum("links").alias("n_links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("head"))
    parts = found.where(~F.col("whole")).select(F.col("cls").alias("src"), F.col("root").alias("dst"))
    if not parts.isEmpty():
        spread = connected_components(parts).withColumnRenamed("node", "cls")
        counted = counted.join(spread, "cls", "left").select("cls", "n_links", F.coalesce("head", "component").alias("head"))
    joined = counted.join(classes.select("cls", "class_id"), "cls")
    # a cluster's row is copied, so that a large cluster's classes meet it on several tasks
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    heads = joined.groupBy("head").agg(F.min("class_id").alias("cluster_id")).withColumn("salt", salts)
    named = joined.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(heads, ["head", "salt"]).select("cls", "n_links", "cluster_id", F.lit(True).alias("linked"))
    cluster = F.when(F.col("linked"), F.col("cluster_id")).otherwise(F.col("class_id"))
    known = classes.join(named, "cls", "left").select("name", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cluster.alias("cluster_id"))
    return filed.select(F.col("id").alias(id_col), "name").join(known, "name").select(id_col, "class_id", "n_copies", "n_links", "cluster_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each cluster: the one with the least id, rows
    without an id last.  Each row takes part under a name of its own, so different
    texts without an id, or under one id, are told apart."""
    name = "_keep_one_row"
    # the name is stored, so that a task that runs again finds the same one
    named = written(docs.withColumn(name, F.monotonically_increasing_id()))
    joined = jaccard_join(named, name, text_col, **how).select(name, "cluster_id")
    order = F.struct(F.col(id_col).isNull().alias("without"), F.col(id_col).alias("id"), F.col(name).alias("row"))
    ids = named.select(name, order.alias("order"))
    best = ids.join(joined.hint("merge"), name).groupBy("cluster_id").agg(F.min("order").alias("best"))
    stay = written(best.select(F.col("best.row").alias(name)))
    return named.join(stay.hint("merge"), name, "left_semi").select(*docs.columns)
