"""ZIP-packaged web archives: WARC records inside stored ZIP members, read by range through an index.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj`` (a line a record
with its offset and length), both stored. The reader parses the end record, the ZIP64 records and the central
directory, finds where the stored members lie, and reads single records by range; nothing is extracted.

As with token files, Spark writes the packages as values of a binary column, one row a package.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, attach, materialise, slices

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Source(Protocol):
    size: int

    def read(self, offset: int, length: int) -> bytes: ...


class BytesSource:
    def __init__(self, content) -> None:
        self.view, self.size = memoryview(content), len(content)

    def read(self, offset: int, length: int) -> bytes:
        return bytes(self.view[offset : offset + length])


class FileSource:
    """Any seekable binary file, such as one opened through a filesystem library."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.seek(0, 2)

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)


class Member(NamedTuple):
    offset: int  # of the data
    length: int
    method: int


def _zip64(extra: bytes, wanted: list[bool]) -> list[int]:
    """Values of the ZIP64 extra field, in order, for the fields that need it."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
        at += 4 + size
    raise ValueError("a ZIP64 entry has no ZIP64 field")


def members(source: Source) -> dict[str, Member]:
    """name -> where its data lies, from the central directory."""
    tail_at = max(0, source.size - 65557)
    tail = source.read(tail_at, source.size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (len(tail) - end < 22 or struct.unpack_from("<H", tail, end + 20)[0] != len(tail) - end - 22):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = source.read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack_from("<Q", locator, 8)
        record = source.read(at, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    directory, found, at = source.read(start, size), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, length = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        wanted = [length == 0xFFFFFFFF, packed == 0xFFFFFFFF, header == 0xFFFFFFFF]
        if any(wanted):
            values = iter(_zip64(directory[at + 46 + n_name : at + 46 + n_name + n_extra], wanted))
            length, packed, header = (next(values) if w else v for w, v in zip(wanted, (length, packed, header)))
        local = source.read(header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header for {name}")
        found[name] = Member(header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, method)
        at += 46 + n_name + n_extra + n_comment
    return found


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> Record:
    if raw[:5] != b"WARC/":
        raise ValueError("not a WARC record")
    split = raw.index(b"\r\n\r\n")
    headers = _fields(raw[:split])
    block = raw[split + 4 : split + 4 + int(headers["content-length"])]
    split = block.index(b"\r\n\r\n")
    return Record(headers, _fields(block[:split]), block[split + 4 :])


class Package:
    """Range reads of records from a package."""

    def __init__(self, source: Source, archive: str = ARCHIVE, index: str = INDEX) -> None:
        self.source, found = source, members(source)
        for name in (archive, index):
            if name not in found:
                raise ValueError(f"the package has no {name}")
            if found[name].method != 0:
                raise ValueError(f"{name} is compressed: only stored members can be read by range")
        self.base, where = found[archive], found[index]
        self.lines = source.read(where.offset, where.length).decode().splitlines()

    def entries(self) -> Iterator[dict]:
        for line in self.lines:
            yield json.loads(line[line.index("{") :])

    def record(self, offset: int, length: int) -> Record:
        if offset + length > self.base.length:
            raise ValueError("the index points beyond the archive")
        return parse_record(zlib.decompress(self.source.read(self.base.offset + offset, length), 31))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if value in ("", "none") else int(value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit with the response's HTTP headers and no payload."""
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    more = f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: {record_id(refers_to)}\r\n" if revisit else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: {record_id(page_id)}\r\nWARC-Date: {date}\r\n"
        f"WARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return b"".join((head.encode("utf-8", "replace"), block, b"\r\n\r\n"))


def pack(records: list[tuple[int | None, bytes]]) -> bytes:
    """A package of (page_id, gzip member) in order."""
    offset, lines = 0, []
    for page_id, member in records:
        lines.append(f'page:{"none" if page_id is None else page_id} {{"offset": {offset}, "length": {len(member)}, "filename": "data.warc.gz"}}')
        offset += len(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(zipfile.ZipInfo(ARCHIVE), b"".join(m for _, m in records))
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
    return out.getvalue()


_PACKAGE = T.StructType([T.StructField("n_records", T.LongType()), T.StructField("content", T.BinaryType())])


def write_packages(pages: DataFrame, least_bytes: int = 0, package_bytes: int = 4 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write every page as a record; equal payloads of ``least_bytes`` or more once, by the smallest page_id.

    Rows that repeat that page_id are responses too, as they are the same record. Digests are grouped with partial
    aggregation, so a large group of copies sends one row a task; only digests met twice are joined back.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(as_long("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = groups.where("n > 1").select("digest", "first")
    placed = attach(rows.select("page_id", "url", "html", "digest"), repeated, ["digest"], "payloads", row_bytes=100)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            out = pa.RecordBatch.from_arrays([pa.array([len(held)]), pa.array([pack(held)], pa.binary())], names=_PACKAGE.names)
            held, size = [], 0
            return out

        for whole in batches:
            for batch in slices(whole, text=2):
                for page_id, url, html, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    data = (html or "").encode()
                    revisit = first is not None and page_id != first
                    raw = make_record(page_id, url, data, base64.b32encode(bytes.fromhex(digest)).decode(), first, revisit, date)
                    zip_ = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = zip_.compress(raw) + zip_.flush()
                    held.append((page_id, member))
                    size += len(member)
                    if size >= package_bytes:
                        yield flush()
        if held:
            yield flush()

    ordered = placed.select("page_id", "url", "html", "digest", "first")
    return materialise(ordered.mapInArrow(scan, _PACKAGE), "warc", compression="uncompressed")


_READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
    ]
)


def read_packages(packages: DataFrame, column: str = "content") -> DataFrame:
    """A row for each record of each package; the digest of a response is taken anew and must agree with its header."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if not content.is_valid:
                    continue
                package, rows = Package(BytesSource(content.as_buffer())), []
                for entry in package.entries():
                    r = package.record(entry["offset"], entry["length"])
                    kind, digest = r.headers["warc-type"], r.headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(r.payload).digest()).decode() != digest:
                        raise ValueError(f"{r.headers['warc-record-id']} is damaged")
                    size = len(r.payload) if kind == "response" else int(r.http["content-length"])
                    rows.append((_page_id(r.headers["warc-record-id"]), size, digest, kind, _page_id(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*rows) if rows else [()] * 6, _TYPES)], names=_READ.names)

    return packages.select(column).mapInArrow(scan, _READ)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write and read back. Null pages have an empty payload; a null page_id is written as ``none`` and is the least of
    its group only where all are null (its records are then responses); an empty table has no packages and no rows."""
    return read_packages(write_packages(pages, **options))
