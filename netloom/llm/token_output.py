"""Token ids as length-delimited binary records with an offset index.

A shard is a run of records in ascending key order:

    length of data   unsigned 64-bit little-endian
    masked checksum of those eight bytes   unsigned 32-bit
    data   one byte (1 where the key is null), key (signed 64-bit, zero where it is
           null), then the ids, 16-bit where the vocabulary fits, else 32-bit (the
           shard's name ends in .u16 / .u32)
    masked checksum of data   unsigned 32-bit

The checksum is CRC-32, masked as TFRecord files mask theirs (rotated right by 15
bits plus a constant), so that a checksum of data holding checksums stays good.
Beside each shard lies ``<shard>.idx``, a 16-byte header and for each record its
offset and key (``NULL_KEY`` for null; the record itself tells), so that a reader can
fetch records in any order.  A shard is closed at ``MAX_SHARD_BYTES``.

Tasks write under names of their own (shard and a random suffix) and return one
manifest row each; only files named by the manifest are ever read, so a task that
is run twice or lost with its executor leaves the result unchanged.

Defined results: a null or empty text is a record with the end id alone; repeated
keys and rows are records of their own, in an order fixed by (key, text); an
empty table gives an empty manifest.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import shared_dir
from netloom.llm.pieces import PieceBPE

NULL_KEY = -(2**63)
_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_SUM = struct.Struct("<I")
_KEY = struct.Struct("<?q")
_KEY_BYTES = 9
_MAGIC = b"NLIX\x01\x00\x00\x00"
# A text is cut at ASCII white space; characters that str.split() also takes are looked for first.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_PART = re.compile("[^ \t-\r]+")
MAX_HELD = 500_000
#: A shard is closed once it has so many bytes.
MAX_SHARD_BYTES = 256 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    n = struct.pack("<Q", len(data))
    return b"".join((n, _SUM.pack(masked(n)), data, _SUM.pack(masked(data))))


def key_bytes(key: int | None) -> bytes:
    return _KEY.pack(key is None, key or 0)


def key_of(data: bytes) -> int | None:
    null, key = _KEY.unpack_from(data)
    return None if null else key


def index_bytes(index: list[tuple[int, int]]) -> bytes:
    """Offsets and keys of a shard's records, after a 16-byte header."""
    return _MAGIC + struct.pack("<Q", len(index)) + np.array(index, "<i8").tobytes()


def read_frame(f) -> bytes | None:
    """The next record's data; None at the end; ValueError if it is damaged."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise ValueError("damaged length")
    n = _HEAD.unpack(head)[0]
    data, crc = f.read(n), f.read(4)
    if len(data) < n or len(crc) < 4 or masked(data) != _SUM.unpack(crc)[0]:
        raise ValueError("damaged record")
    return data


class TextEncoder:
    """Ids of whole texts, from the ids of their parts between ASCII white space.
    Parts met before are held, ``MAX_HELD`` at most."""

    def __init__(self, path: str, dtype: str):
        self.bpe, self.held = PieceBPE(path, width=np.dtype(dtype).itemsize), {}

    def __call__(self, text: str) -> bytes:
        parts = _PART.findall(text) if _OTHER_SPACE.search(text) else text.split()
        held = self.held
        new = set(parts).difference(held)
        if new:
            if len(held) + len(new) > MAX_HELD:
                held.clear()
                new = set(parts)
            ids = self.bpe.ids
            for p in new:
                held[p] = ids(p)
        return b"".join(map(held.__getitem__, parts))


def _encoder(path: str, dtype: str) -> TextEncoder:
    global _HELD
    if _HELD is None or _HELD[0] != (path, dtype):
        _HELD = ((path, dtype), TextEncoder(path, dtype))
    return _HELD[1]


_HELD = None


def open_fs(uri: str):
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")


def cuts_at_space(tokenizer) -> bool:
    """Whether this tokenizer drops white space, so that texts may be cut at it."""
    import json

    pre = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
    return pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed"


def write_token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_shard_bytes: int = MAX_SHARD_BYTES) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards in ascending
    ``id_col`` order below ``path`` (the shared folder if not given).

    Returns the manifest: shard, path, dtype, n_records, n_tokens, start (ids in
    all shards before).  It has one row per shard.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    if not cuts_at_space(tokenizer):
        raise ValueError("this tokenizer keeps white space; texts can't be cut there")
    dtype = "<u2" if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    spark, base = docs.sparkSession, path or shared_dir(docs.sparkSession)
    end = np.array([end_id], dtype).tobytes()
    width = len(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        encode, shard, out = _encoder(tokenizer_path, dtype), TaskContext.get().partitionId(), None
        fs, root = open_fs(base)
        part = 0

        def closed():
            out.close()
            with fs.open_output_stream(name + ".idx") as f:
                f.write(index_bytes(index))
            row = ([shard], [part], [name], [dtype], [len(index)], [n_tokens])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "part", "path", "dtype", "n_records", "n_tokens"])

        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/shard-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.{'u16' if width == 2 else 'u32'}"
                    out, at, index, n_tokens = fs.open_output_stream(name, buffer_size=1 << 20), 0, [], 0
                ids = encode(text.as_py()) + end
                record = frame(key_bytes(key) + ids)
                out.write(record)
                index.append((at, NULL_KEY if key is None else key))
                at += len(record)
                n_tokens += len(ids) // width
                if at >= max_shard_bytes:
                    yield closed()
                    out, part = None, part + 1
        if out is not None:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    made = dealt.mapInArrow(run, "shard int, part int, path string, dtype string, n_records long, n_tokens long").collect()
    manifest, start = [], 0
    for i, r in enumerate(sorted(made, key=lambda r: (r.shard, r.part))):  # a row for each shard of max_shard_bytes
        manifest.append((i, r.path, r.dtype, r.n_records, r.n_tokens, start, base))
        start += r.n_tokens
    return spark.createDataFrame(manifest, "shard int, path string, dtype string, n_records long, n_tokens long, start long, base string")


def read_token_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The records of a manifest: key, start, n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, _ = open_fs(r["base"])
                rows, held, start, dtype = [], 0, r["start"], r["dtype"]
                with fs.open_input_stream(r["path"], buffer_size=1 << 20) as f:
                    while (data := read_frame(f)) is not None:
                        ids = np.frombuffer(data, dtype, offset=_KEY_BYTES).astype("<u4")
                        rows.append((key_of(data), start, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype("<i4")] if with_ids else [])))
                        start, held = start + len(ids), held + len(data)
                        if len(rows) >= 4096 or held > 16 << 20 and with_ids:
                            yield columns(rows)
                            rows, held = [], 0
                yield columns(rows)

    kinds = [("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

    def columns(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    # a shard is one task's work
    files = manifest.repartition(max(1, manifest.count()), "path") if manifest.count() else manifest
    return files.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def read_record_at(uri: str, path: str, n: int) -> tuple[int | None, np.ndarray]:
    """Record ``n`` of a shard through its offset index, for shuffled reads."""
    fs, _ = open_fs(uri)
    with fs.open_input_file(path + ".idx") as f:
        if f.read(8) != _MAGIC:
            raise ValueError("no offset index")
        f.seek(16 + 16 * n)
        offset = struct.unpack("<q", f.read(16)[:8])[0]
    with fs.open_input_file(path) as f:
        f.seek(offset)
        data = read_frame(f)
    return key_of(data), np.frombuffer(data, "<u2" if path.endswith(".u16") else "<u4", offset=_KEY_BYTES)
