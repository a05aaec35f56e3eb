"""Benchmark decontamination by a broadcast set of normalised test windows.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.
A window is 13 consecutive words of a benchmark item; a shorter item with at
least one word is a single window of its own length.  The windows (hash, words,
items) go to every executor as one broadcast: flat arrays, about 20 bytes a window
beside the block's distinct words.  A block holds at most ``MAX_BROADCAST_BYTES`` of
benchmark text (and whole items); a larger benchmark is dealt into blocks by hash,
and one block after another is built, sent, scanned for and dropped, so that neither
the driver nor a worker ever holds two.  The hits of a document are merged after.
Every hash hit is verified against the words.

Defined results: a null or empty text has no words, no hits and is not
contaminated; repeated documents and ties each get their own equal row; null
items never match; extra columns are ignored (``scan``) or kept
(``remove_contaminated``).  Texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written

WINDOW = 13
#: Bound for the text of one broadcast block of the benchmark.
MAX_BROADCAST_BYTES = 16 << 20
MAX_HELD = 100_000

# Upper-case ASCII becomes lower case; ASCII that is no letter or digit becomes a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class WindowSet:
    """The windows of a block of benchmark items: vocabulary, all items' words as
    numbers, and for each window length the sorted hashes and places of the windows."""

    def __init__(self, items, window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items, parts = [], []
        for item, text in items:
            if words := words_of(text):
                self.items.append(str(item))
                parts.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int32))
        lengths = np.array([len(x) for x in parts], dtype=np.int64)
        self.ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        self.starts = np.cumsum(lengths) - lengths
        self.sizes, self.held = [], {}
        for size in np.unique(np.minimum(lengths, window)).tolist():
            whole = np.minimum(lengths, window) == size
            n = lengths[whole] - size + 1
            at = np.repeat(self.starts[whole] - np.cumsum(n) + n, n) + np.arange(n.sum())
            h = self.hashes(self.ids, at, size)
            order = np.argsort(h, kind="stable")
            self.sizes.append((size, h[order], at[order]))

    @staticmethod
    def hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[at + j].astype(np.uint64)
        return h ^ (h >> np.uint64(29))

    def items_with(self, size: int, places: np.ndarray, left: int, right: int) -> dict[bytes, list[int]]:
        """Windows (as bytes) of one hash, each with the items that hold it."""
        got = self.held.get((size, left))
        if got is None:
            if len(self.held) > MAX_HELD:
                self.held.clear()
            found: dict[bytes, set] = {}
            for p in places[left:right].tolist():
                found.setdefault(self.ids[p : p + size].tobytes(), set()).add(int(np.searchsorted(self.starts, p, "right")) - 1)
            got = self.held[size, left] = {k: sorted(v) for k, v in found.items()}
        return got

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """For each word whether a window covers it; the items with a window."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))
        covered, found = np.zeros(len(ids) + 1, dtype=np.int64), set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, hashes, places in self.sizes:
            if len(ids) < size:
                continue
            starts = np.nonzero(known[size:] - known[:-size] == size)[0]  # windows of known words only
            if not len(starts):
                continue
            h = self.hashes(ids, starts, size)
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.nonzero(right > left)[0].tolist():
                at = int(starts[k])
                if items := self.items_with(size, places, int(left[k]), int(right[k])).get(ids[at : at + size].tobytes()):
                    covered[at] += 1
                    covered[at + size] -= 1
                    found.update(items)
        return np.cumsum(covered[:-1]) > 0, {self.items[i] for i in found}


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(a), int(z)) for a, z in edge.reshape(-1, 2)]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans."""
    data = text.encode("utf-8", "surrogatepass")
    out, last, hit = [], 0, {i for a, z in spans for i in range(a, z)}
    for k, m in enumerate(_WORD.finditer(data.translate(_FOLD))):
        if k in hit:
            out.append(data[last : m.start()])
            last = m.end()
    return re.sub(r"[ \t]{2,}", " ", b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass"))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_HITS = "n_words long, n_hit long, items array<string>, hit_spans array<struct<start:int,end:int>>"


def _hits(texts, held) -> list[pa.Array]:
    rows = []
    for text in texts:
        words = words_of(text.as_py())
        hit, found = held.value.hits(words)
        rows.append((len(words), int(hit.sum()), sorted(found), [{"start": a, "end": z} for a, z in spans_of(hit)]))
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS))]


def _scan(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, max_bytes: int) -> DataFrame:
    """``id`` and ``_HITS`` of every row of ``docs``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null and item is not null")
    n = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max_bytes) + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def hits(rows: DataFrame, block: int, name: str, kind: str) -> tuple:
        part = dealt.where(F.col("block") == block) if n > 1 else items
        held = spark.sparkContext.broadcast(WindowSet((r.item, r.text) for r in part.toLocalIterator()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(name), *_hits(batch.column("text"), held)], [name, "n_words", "n_hit", "items", "hit_spans"])

        return rows.select(name, "text").mapInArrow(run, f"{name} {kind}, {_HITS}"), held

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if n == 1:
        return hits(rows, 0, "id", id_type)[0]
    named = written(rows.withColumn("row", F.monotonically_increasing_id()))
    every = None
    for block in range(n):
        found, held = hits(named, block, "row", "long")
        found = written(found if block == 0 else found.where("n_hit > 0"))
        held.destroy()
        every = found if every is None else every.unionByName(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                hit = np.zeros(r["n_words"], dtype=bool)
                for s in r["hit_spans"]:
                    hit[s["start"] : s["end"]] = True
                out.append((r["row"], r["n_words"], int(hit.sum()), sorted(set(r["items"])), [{"start": a, "end": z} for a, z in spans_of(hit)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS))], ["row", "n_words", "n_hit", "items", "hit_spans"])

    gathered = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"))
    merged = gathered.mapInArrow(merge, f"row long, {_HITS}")
    return named.select("row", "id").join(merged, "row").drop("row")


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES, spans: bool = False) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, items (ids as sorted
    strings), contaminated; with ``spans`` also the hit word positions
    ``[start, end)`` as ``hit_spans``."""
    out = _scan(docs, benchmark, id_col, text_col, item_col, item_text_col, max_broadcast_bytes)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", contaminated().alias("contaminated"), *(["hit_spans"] if spans else []))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", mode: str = "documents", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Drop contaminated documents, or (``mode="spans"``) cut the hit words out of
    every text and keep the document.  All columns stay as they are."""
    # the whole row goes through the scan as its id
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    found = _scan(whole, benchmark, "_row", "_text", "item_id", "text", max_broadcast_bytes)
    if mode == "documents":
        return found.where(~contaminated()).select("id.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if not s.as_py() else without(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()]) for t, s in zip(batch.column("text"), batch.column("hit_spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    row = docs.schema.simpleString()
    done = found.select("id", F.col(f"id.`{text_col}`").alias("text"), "hit_spans").mapInArrow(cut, f"id {row}, text string")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"id.`{c}`") for c in docs.columns])
