"""WARC archives: a Python data source that reads and writes them, and the
response/revisit decision for pages with equal payloads.

Writing makes one gzip member per record.  A member's header carries the extra
field ``sl`` (the member's compressed and plain length), so that a reader that
doesn't want a record steps over it without inflating it.  Each task rotates its
files at ``maxFileBytes``; the driver's commit writes ``_MANIFEST``, and only
files named there are read, so files of failed or repeated attempts don't count.

A second write into a folder adds its files to the manifest.  A folder without a
manifest, or a single file, is read too: members without the extra field are
inflated to be passed over, and plain records are stepped over by their length.

Reading plans partitions from file sizes, takes record-type and other header
predicates from the query (``spark.sql.python.filterPushdown.enabled``), inflates
the first bytes of a record for its headers, and inflates and decodes the payload
only of records that pass, and only with the option ``payload`` left on.

Defined results: a null payload is an empty one; a null url or page_id leaves its
header out and reads back as null; repeated rows are records of their own; an
empty table makes an archive without records; extra columns are not written.
"""

from __future__ import annotations

import datetime
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from netloom.llm.common import shared_dir, written

SCHEMA = "record_id string, record_type string, target_uri string, date string, page_id long, payload_digest string, payload_length long, refers_to long, headers map<string,string>, payload binary"
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "date", "page_id", "payload_digest", "payload_length", "refers_to")
#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 100
#: Bound for the broadcast of repeated digests (about 150 bytes a row).
MAX_BROADCAST_ROWS = 200_000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = struct.Struct("<4sIBBH2sHII")
_OFF = 12 + 12


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")


def _urn(page_id) -> str:
    return f"<urn:page:{page_id}>"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url, payload: bytes, record_type: str, digest: str, refers_to, date: str) -> bytes:
    """A plain WARC/1.1 record; a revisit's block ends with its HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_urn(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if record_type == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """One gzip member with the extra field ``sl``."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    total = _OFF + len(body) + 8
    return _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, total, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def _header_row(h: dict[str, str]) -> dict:
    number = lambda k: int(h[k]) if k in h else None
    ref = re.match(r"<urn:page:(-?\d+)>", h.get("WARC-Refers-To", ""))
    return {
        "record_id": h.get("WARC-Record-ID"),
        "record_type": h.get("WARC-Type"),
        "target_uri": h.get("WARC-Target-URI"),
        "date": h.get("WARC-Date"),
        "page_id": number("X-Page-Id"),
        "payload_digest": h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
        "payload_length": number("X-Payload-Length"),
        "refers_to": int(ref[1]) if ref else None,
    }


def _passes(row: dict, filters) -> bool:
    for op, col, value in filters:
        got = row[col]
        if op == "notnull":
            ok = got is not None
        elif op == "safe":
            ok = got == value
        elif got is None:
            ok = False
        else:
            ok = {"=": lambda: got == value, "in": lambda: got in value, "<": lambda: got < value, "<=": lambda: got <= value, ">": lambda: got > value, ">=": lambda: got >= value, "starts": lambda: got.startswith(value)}[op]()
        if not ok:
            return False
    return True


class _Member:
    """A record's bytes as they come: ``read(n)`` gives at most ``n`` more, b"" at the
    end; ``close`` leaves the file at the next record."""

    def __init__(self, f):
        self.f, self.at = f, f.tell()
        fixed = f.read(_OFF)
        self.empty = not fixed
        self.inflate = self.total = None
        if fixed[:4] == b"\x1f\x8b\x08\x04" and len(fixed) == _OFF and fixed[12:14] == b"sl":
            self.total = _MEMBER.unpack(fixed)[7]
            self.inflate, self.left = zlib.decompressobj(-15), self.total - _OFF - 8
        else:
            f.seek(self.at)
            if fixed[:2] == b"\x1f\x8b":
                self.inflate, self.left = zlib.decompressobj(31), 1 << 62

    def read(self, n: int) -> bytes:
        if self.inflate is None:
            return self.f.read(n)
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.f.read(min(self.left, 4096))
                self.left -= len(raw)
                if not raw:
                    break
            if got := self.inflate.decompress(raw, n):
                return got
        return b""

    def close(self, start: int, length: int, got: int) -> None:
        """``start`` and ``length`` of the block, of which ``got`` bytes were read."""
        if self.total is not None:
            self.f.seek(self.at + self.total)
        elif self.inflate is None:
            self.f.seek(self.at + start + length + 4)
        else:
            while self.read(1 << 16):
                pass
            self.f.seek(self.f.tell() - len(self.inflate.unused_data))


def read_records(f, filters=(), payload: bool = True) -> Iterator[dict]:
    """Records of an open archive.  Headers come first; a record that fails the
    filters is stepped over."""
    while True:
        member = _Member(f)
        if member.empty:
            return
        plain = b""
        while b"\r\n\r\n" not in plain and (more := member.read(4096)):
            plain += more
        head, _, block = plain.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = _parse_head(head)
        row, length = _header_row(headers), int(headers["Content-Length"])
        if _passes(row, filters):
            row["headers"] = headers
            if payload and row["record_type"] == "response":
                parts, n = [block], len(block)
                while n < length and (more := member.read(min(length - n, 1 << 20))):
                    parts.append(more)
                    n += len(more)
                block = b"".join(parts)[:length]
                row["payload"] = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            yield row
        member.close(len(head) + 4, length, len(block))


def _manifest(fs, root: str) -> list | None:
    """Names and sizes of the archive's files; None if there is no manifest."""
    if fs.get_file_info(f"{root}/_MANIFEST").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/_MANIFEST") as f:
        return [tuple(x) for x in json.loads(f.read())]


@dataclass
class _Files(InputPartition):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.pack = int(options.get("packbytes", 32 << 20))
        self.filters: list = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "=", EqualNullSafe: "safe", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in", StringStartsWith: "starts"}
        for x in filters:
            name = getattr(x, "attribute", ())  # negations have none
            col = name[0] if len(name) == 1 else None
            if col in HEADER_COLUMNS and isinstance(x, IsNotNull):
                self.filters.append(("notnull", col, None))
            elif col in HEADER_COLUMNS and type(x) in kinds:
                self.filters.append((kinds[type(x)], col, x.value))
            else:
                yield x

    def partitions(self):
        fs, root = _fs(self.path)
        about = fs.get_file_info(root)
        if about.type == pafs.FileType.File:
            return [_Files([""])]
        files = _manifest(fs, root)
        if files is None:
            found = fs.get_file_info(pafs.FileSelector(root))
            files = [(x.base_name, x.size) for x in found if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        packs, held = [], None
        for name, size in sorted(files):
            if held is None or held[1] + size > self.pack:
                packs.append(held := [[], 0])
            held[0].append(name)
            held[1] += size
        return [_Files(names) for names, _ in packs] or [_Files([])]

    def read(self, partition):
        fs, root = _fs(self.path)
        kind = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for name in partition.names:
            rows, held = [], 0
            with fs.open_input_file(f"{root}/{name}" if name else root) as f:
                for row in read_records(f, self.filters, self.payload):
                    row["headers"] = [*row["headers"].items()]
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, payload, record_type, payload_digest, refers_to."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("maxfilebytes", 64 << 20))
        self.date = options.get("date") or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size, name = [], None, 0, ""
        for batch in iterator:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "record_type", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                page, url, payload, kind, digest, ref = (c[i].as_py() for c in cols)
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                member = gzip_member(record_bytes(page, url, payload or b"", kind, digest, ref, self.date))
                out.write(member)
                size += len(member)
                if size >= self.most:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        before = [] if self.overwrite else _manifest(fs, root) or []
        with fs.open_output_stream(f"{root}/_MANIFEST") as f:
            f.write(json.dumps(before + [x for m in messages if m is not None for x in m.files]).encode())


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows for the writer: each page with its payload, digest, record type and
    the page that a revisit refers to.

    Of pages with equal payloads of ``MIN_REVISIT_BYTES`` or more the smallest id
    is the response (also each repeated row with that id); pages without an id
    revisit it; if none of them has an id, all are responses.  Only digests and
    ids are grouped (with partial aggregation, so that a hot payload is one row a
    task); what comes back is the table of repeated digests, which is broadcast up
    to ``max_broadcast_rows`` and else joined by shuffle, where adaptive execution
    splits a hot digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    repeated = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = written(repeated)
    if repeated.count() <= max_broadcast_rows:
        repeated = F.broadcast(repeated)
    out = rows.join(repeated, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select(
        "page_id",
        "url",
        F.when(revisit, F.lit("revisit")).otherwise("response").alias("record_type"),
        "payload_digest",
        F.when(revisit, F.col("first")).alias("refers_to"),
        "payload",
    )


def write_archive(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write one record per page; returns the archive's folder."""
    register(pages.sparkSession)
    path = path or shared_dir(pages.sparkSession)
    revisits(pages, **columns).write.format("warc").mode("append").option("path", path).save()
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
