"""Phrases of two and three words that occur together more than by chance: SON.

Words are counted a language at a time (null: ``und``).  A text's A-Z are lower-cased,
it is split at ``. , ; : ! ?`` and line ends into pieces and those at spaces and tabs
into words; a phrase lies within one piece.

1. *Shards.*  The scan's tasks belong to ``SHARDS`` shards.  A phrase that occurs
   ``min_count`` times in all occurs ``local_support`` times in one of them at least.
   A task counts the hashed phrases of bounded runs of text and deals the counts by
   hash range; each range of a shard is summed whole, so the shard is mined completely
   at the lowered support, in memory that doesn't grow with the shard.  Words are
   counted exactly on the way.
2. *Union.*  Phrases frequent in any shard set a bit of a map of bounded size, which
   goes to every task.  A hash or bit shared by two phrases, or a map that a huge corpus
   fills, only lets more phrases through; none is lost.
3. *Exact count.*  The texts are read again; phrases with their bit set are counted as
   strings, ``min_count`` is applied to the exact sums.
4. *Score.*  Joins with the counts of the parts, in decimals.

A frequent phrase is one count in each run of text before anything is shuffled, so no
key is hot.  Defined results: null, empty and word-free texts count nothing; repeated
rows count each time; ids and other columns are ignored; an empty table gives no rows.
Phrases beyond 10^15 occurrences would pass the decimals' 38 digits (an error).
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import written

MIN_COUNT, LONGEST, TOP = 10, 3, 2000
SHARDS = 3
#: Bits of the map of locally frequent phrases (32 MB), and words held by a task.
MAP_BITS, RUN_WORDS = 28, 1_500_000
#: Hash ranges are a power of two that grows with the root of the text, since every run
#: gives a row to each; but a range never has more than ``RANGE_BYTES`` of text.
STEP_BYTES, RANGE_BYTES, MAX_RANGE_BITS = 8 << 20, 256 << 20, 20
#: Parts of a language's phrases that are ranked first, so that its end ranking is bounded.
PARTS = 64
#: Bytes of one text that are split into words at a time.
STEP = 1 << 20

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9 + b" ")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def local_support(min_count: int, shards: int) -> int:
    """The least count that some shard must hold of a phrase with ``min_count``."""
    return -(-min_count // shards)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text with ``.`` at every piece's end, some at a time."""
    data = text.translate(_TABLE)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > STEP:
            cut = max(data.rfind(b" ", at, at + STEP), data.rfind(b".", at, at + STEP))
            # a word longer than a step is kept whole
            found = [p for p in (data.find(b" ", at + STEP), data.find(b".", at + STEP)) if p >= 0] if cut < 0 else [cut]
            end = min(found) + 1 if found else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end
    yield [b"."]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Run:
    """Words of one language, held until they are counted."""

    def __init__(self, lang: str, longest: int):
        self.lang, self.longest = lang, longest
        self.start([])

    def start(self, carried: list[bytes]) -> None:
        """Begins anew after ``carried``, the last words of a text that goes on."""
        self.vocabulary = defaultdict(itertools.count(1).__next__, {b".": 0})
        self.parts, self.held, self.counted = [], 0, len(carried)
        self.add(carried)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int64, count=len(words)))
        self.held += len(words)

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hash, word numbers (one row a word) and count of the distinct phrases of
        each length; phrases that end within the carried words are left out."""
        ids, base = np.concatenate(self.parts), len(self.vocabulary)
        self.words = [*self.vocabulary]
        seed = xxhash.xxh3_64_intdigest(self.lang)
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), dtype=np.uint64, count=base)
        # a phrase's key: a column of ``table``, its first words, then a digit a word
        key, whole, table, digits = ids, ids > 0, np.arange(base)[None, :], 0

        def parted(key: np.ndarray) -> np.ndarray:
            last = []
            for _ in range(digits):
                key, digit = np.divmod(key, base)
                last.append(digit)
            return np.stack([*(row[key] for row in table), *reversed(last)])

        for length in range(1, self.longest + 1):
            if length > 1:
                if len(ids) < length:
                    return
                if table.shape[1] * base ** (digits + 1) >= 1 << 63:
                    distinct, key = np.unique(key, return_inverse=True)
                    table, digits = parted(distinct), 0
                key, whole, digits = key[:-1] * base + ids[length - 1 :], whole[:-1] & (ids[length - 1 :] > 0), digits + 1
            after = max(0, self.counted - length + 1)
            distinct, count = np.unique(key[after:][whole[after:]], return_counts=True)
            numbers = parted(distinct)
            h = np.full(len(distinct), length, dtype=np.uint64)
            for row in numbers:
                h = _mixed((h ^ hashed[row]) * _GOLD)
            yield _mixed(h * _GOLD), numbers, count

    def strings(self, numbers: np.ndarray) -> list[bytes]:
        words = self.words
        return [b" ".join([words[i] for i in row]) for row in numbers.T.tolist()]


def runs(batches: Iterator[pa.RecordBatch], longest: int, run_words: int) -> Iterator[Run]:
    """Bounded runs of words, a language each, cut anywhere without losing a phrase."""
    by_lang: dict[str, Run] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            lang = lang.as_py()
            run = by_lang.get(lang)
            if run is None:
                run = by_lang[lang] = Run(lang, longest)
            tail: list[bytes] = []
            for words in tokens(text.as_buffer().to_pybytes()):
                run.add(words)
                total += len(words)
                tail = (tail + words)[-(longest - 1) :] if longest > 1 else []
                if total >= run_words:
                    yield from (r for r in by_lang.values() if r.held > r.counted)
                    by_lang = {lang: run}
                    run.start(tail)
                    total = len(tail)
    yield from (r for r in by_lang.values() if r.held > r.counted)


def _packed(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of ``hashes`` by their first ``bits`` bits."""
    if not len(hashes):
        return
    group = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(group[order][1:] != group[order][:-1]) + 1
    for part in np.split(order, cuts):
        yield int(group[part[0]]), part


_MINED = "lang string, length int, piece int, shard int, phrases binary, counts binary"
_NAMES = [x.split()[0] for x in _MINED.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str):
    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    return itertools.groupby(rows(), key=lambda r: tuple(r[k] for k in keys))


def _summed(rows: Iterator[dict]) -> dict[bytes, int]:
    got: dict[bytes, int] = defaultdict(int)
    for r in rows:
        for phrase, n in zip(r["phrases"].split(b"\n"), np.frombuffer(r["counts"], dtype=np.int64).tolist(), strict=True):
            got[phrase] += n
    return got


def _mine(longest: int, run_words: int, bits: int, shards: int, support: int):
    """Words as strings with counts, longer phrases as 32 more bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for r in runs(batches, longest, run_words):
            for length, (hashes, numbers, count) in enumerate(r.counts(), 1):
                rest = ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                out = []
                for piece, part in _packed(hashes, bits):
                    if length == 1:
                        phrases, counts = b"\n".join(r.strings(numbers[:, part])), count[part].astype(np.int64)
                    else:
                        phrases, counts = rest[part].tobytes(), np.minimum(count[part], support).astype(np.uint8)
                    out.append((r.lang if length == 1 else "", min(length, 2), piece, shard if length > 1 else 0, phrases, counts.tobytes()))
                if out:
                    yield _batch(out, _NAMES, _TYPES)

    return run


def _frequent(rest: np.ndarray, counts: np.ndarray, support: int) -> np.ndarray:
    order = np.argsort(rest, kind="stable")
    rest, counts = rest[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
    return rest[first][np.add.reduceat(counts, first) >= support]


def _unite(bits: int, map_bits: int, support: int, min_count: int):
    """Sums a range: words with their counts, and the range's part of the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["lang", "phrase", "f", "n", "piece", "bits"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for (length, piece, lang), rows in _grouped(batches, "length", "piece", "lang"):
            if length == 1:
                got = _summed(rows)
                out = [(lang, w.decode("utf-8", "replace"), n, None, None, None) for w, n in got.items() if n >= min_count]
                yield _batch([*out, (lang, None, None, sum(got.values()), None, None)], names, types)
                continue
            part = np.zeros(1 << (map_bits - bits), dtype=bool)
            for _, shard in itertools.groupby(rows, key=lambda r: r["shard"]):
                rest, counts = [], []
                for r in shard:
                    rest.append(np.frombuffer(r["phrases"], dtype=np.uint32))
                    counts.append(np.frombuffer(r["counts"], dtype=np.uint8))
                part[_frequent(np.concatenate(rest), np.concatenate(counts), support) >> np.uint32(32 - map_bits + bits)] = True
            yield _batch([(None, None, None, None, piece, np.packbits(part).tobytes())], names, types)

    return run


def _count(longest: int, run_words: int, bits: int, map_bits: int, held):
    """Phrases whose bit is set, as strings with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(held.value, dtype=np.uint8)
        for r in runs(batches, longest, run_words):
            for length, (hashes, numbers, count) in enumerate(r.counts(), 1):
                if length == 1:
                    continue
                bit = (hashes >> np.uint64(64 - map_bits)).astype(np.int64)
                stay = np.flatnonzero((bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
                out = []
                for piece, part in _packed(hashes[stay], bits):
                    part = stay[part]
                    out.append((r.lang, length, piece, 0, b"\n".join(r.strings(numbers[:, part])), count[part].astype(np.int64).tobytes()))
                if out:
                    yield _batch(out, _NAMES, _TYPES)

    return run


def _total(min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (length, _, lang), rows in _grouped(batches, "length", "piece", "lang"):
            out = [(lang, length, p.decode("utf-8", "replace"), n) for p, n in _summed(rows).items() if n >= min_count]
            yield _batch(out, ["lang", "length", "phrase", "a"], [pa.string(), pa.int32(), pa.string(), pa.int64()])

    return run


def counted_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS, map_bits: int = MAP_BITS, run_words: int = RUN_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words ``lang, phrase, f`` and phrases ``lang, length, phrase, a`` that occur
    ``min_count`` times, and all words' number ``lang, n``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(MAX_RANGE_BITS, map_bits - 3, max(4, int(8 * (size / STEP_BYTES) ** 0.5).bit_length(), (size // RANGE_BYTES).bit_length()))
    support = local_support(min_count, shards)
    by = ("length", "piece", "lang")
    mined = texts.mapInArrow(_mine(longest, run_words, bits, shards, support), _MINED).repartition(*by).sortWithinPartitions(*by, "shard")
    united = written(mined.mapInArrow(_unite(bits, map_bits, support, min_count), "lang string, phrase string, f long, n long, piece int, bits binary"))
    step = 1 << (map_bits - bits - 3)
    bitmap = bytearray(1 << (map_bits - 3))
    for r in united.where("bits is not null").select("piece", "bits").collect():  # 2^map_bits bits in all
        bitmap[r.piece * step : (r.piece + 1) * step] = r.bits
    held = spark.sparkContext.broadcast(bytes(bitmap))
    counted = texts.mapInArrow(_count(longest, run_words, bits, map_bits, held), _MINED).repartition(*by).sortWithinPartitions(*by)
    phrases = written(counted.mapInArrow(_total(min_count), "lang string, length int, phrase string, a long"))
    held.unpersist()
    words = united.where("f is not null").select("lang", "phrase", "f")
    return words, phrases, united.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    words, phrases, sizes = counted_phrases(docs, **how)
    parts = words.select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", F.col("a").alias("f")))
    split = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    cuts = phrases.select("lang", "length", "phrase", "a", cut).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("rest"),
    )
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: f"cast({c} as decimal(38,0))"
    score = F.expr(f"cast(({wide('a')} * {wide('a')} * cast(1000000 as decimal(38,0))) div ({wide('l')} * {wide('r')}) as long)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # a phrase inside a longer one that is at least half as frequent goes
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("length") - m + 1), lambda i: F.array_join(F.slice(split, i, m), " ")))))
    longer = phrases.where("length > 2").select("lang", inner.alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = best.join(longer, ["lang", "phrase"], "left").where("b is null or 100 * b < 50 * a")
    # the first of each part of a language, then of the language
    order = (F.desc("best.score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
