"""Web archives in ZIP packages: writing WARC records, and reading them by range without extraction.

A package is a ZIP file whose members are stored, not compressed: archive/data.warc.gz with one gzip member per record
and indexes/index.cdxj with one line per record (key, offset, length).  The reader finds the end-of-central-directory
record in the file's tail, follows the ZIP64 locator if there is one, reads the central directory, finds each stored
member's place from its local header, and then reads the index and the records by byte range.

Of rows with equal payloads of LEAST bytes or more, the one with the largest page_id is a response, the others revisit
it (identical-payload-digest).  Smaller payloads are always responses.

Defined results: null html is an empty payload; a null page_id is smaller than any other; rows that tie on the largest
page_id of their payload are all responses; if a payload's page_ids are all null its rows are all responses; an empty
table gives no packages and no rows; columns other than the id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import NewFile, arrow_schema, ddl, materialize, open_range, partitions_for, read_range, shared_dir

#: Payloads of this many bytes or more are stored once.
LEAST = 1000
#: A package is closed at about this size; it is the unit of reading.
PACKAGE_BYTES = 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_SPACE = uuid.UUID("5f0c5b1e-7d0b-5d51-8f5a-9a6d3c0a1b11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGES = arrow_schema([("package", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS = arrow_schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


# --- records


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record in a gzip member of its own: a response, or a revisit if refers_to is given."""
    digest = hashlib.sha1(payload).hexdigest()
    uri = "".join(c if c.isprintable() and c != " " else "%20" for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block = http + payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        block = http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member; a revisit's payload is empty."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# --- packages


class PackageWriter:
    """Streams records into a new package in the shared folder."""

    def __init__(self, folder: str):
        self.file = NewFile(folder, "pages", ".wacz")
        self.zip = zipfile.ZipFile(self.file.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(_member(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, key: str, record: bytes) -> None:
        self.index.append(f"{key} {json.dumps({'offset': self.size, 'length': len(record)})}\n")
        self.data.write(record)
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(_member(INDEX), "w", force_zip64=True) as out:
            out.write("".join(self.index).encode())
        self.zip.close()
        self.file.commit()
        return self.file.name, len(self.index), self.size


def _member(name: str) -> zipfile.ZipInfo:
    return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int  # bytes in the file
    header: int  # offset of the local header


def _zip64_extra(extra: bytes, wanted: list[bool]) -> list[int]:
    """Values of the ZIP64 field for those of (size, stored size, header offset) that are wanted."""
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return list(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
        at += 4 + length
    raise ValueError("ZIP64 field missing")


def directory(handle, size: int) -> list[Member]:
    """The members of a ZIP file, from its (ZIP64) central directory; only the tail and the directory are read."""
    tail_at = max(0, size - 65_557 - 20)
    tail = read_range(handle, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", tail, at - 12)
        end = read_range(handle, where, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    raw, out, at = read_range(handle, offset, length), [], 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, stored, full = struct.unpack_from("<H8xII", raw, at + 10)
        n, m, k = struct.unpack_from("<HHH", raw, at + 28)
        (header,) = struct.unpack_from("<I", raw, at + 42)
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + m]
        values = [full, stored, header]
        wanted = [v == 0xFFFFFFFF for v in values]
        if any(wanted):
            big = iter(_zip64_extra(extra, wanted))
            values = [next(big) if w else v for w, v in zip(wanted, values)]
        out.append(Member(name, method, values[0], values[1], values[2]))
        at += 46 + n + m + k
    return out


def member_start(handle, member: Member) -> int:
    """Where a stored member's bytes begin, from its local header."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; records can't be read by range")
    head = read_range(handle, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n, m = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + m


def read_package(folder: str, name: str, span: int = 4 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a package in index order; neighbouring records are fetched together, span bytes at a time."""
    with open_range(folder, name) as handle:
        members = {m.name: m for m in directory(handle, handle.size())}
        data, index = members[DATA], members[INDEX]
        lines = read_range(handle, member_start(handle, index), index.stored).decode().splitlines()
        start = member_start(handle, data)
        entries = [json.loads(x.split(" ", 1)[1]) for x in lines]
        at = 0
        while at < len(entries):
            end, size = at, 0
            while end < len(entries) and (end == at or size + entries[end]["length"] <= span):
                size += entries[end]["length"]
                end += 1
            first = entries[at]["offset"]
            raw = read_range(handle, start + first, size)
            for e in entries[at:end]:
                yield parse_record(raw[e["offset"] - first : e["offset"] - first + e["length"]])
            at = end


# --- on tables


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, html and refers_to: the page whose record this one revisits, null for a response."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("big", F.octet_length("html") >= least)
    first = own.filter("big").groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "keep")
    # a payload that a third of all rows share is one row here; Spark splits its large side of the join
    return own.join(first, "digest", "left").select("page_id", "url", "html", F.when(F.col("big") & (F.col("keep") > F.coalesce("page_id", F.col("keep") - 1)), F.col("keep")).alias("refers_to"))


def write_packages(planned: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes planned records into packages in folder; one row per package, kept in folder/manifest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out = out or PackageWriter(f"{folder}/packages")
                out.add(f"page:{page_id}", make_record(page_id, url, html.encode(), refers_to))
                if out.size >= package_bytes:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), PACKAGES.types)], schema=PACKAGES)

    return materialize(planned.mapInArrow(work, ddl(PACKAGES)), f"{folder}/manifest")


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the packages: what the archive says of each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                rows = []
                for fields, payload in read_package(f"{folder}/packages", package):
                    kind, page, target = fields["WARC-Type"], fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response":
                        digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
                        if digest != stated:
                            raise ValueError(f"payload of page {page} doesn't match its digest")
                    else:
                        digest, length = stated, int(fields["X-Payload-Length"])
                    rows.append((None if page is None else int(page), length, digest, kind, None if target is None else int(target), fields["WARC-Target-URI"]))
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 10_000]), RECORDS.types)], schema=RECORDS)

    n = partitions_for(manifest.sparkSession, manifest.count(), 1)  # a package a task
    return manifest.select("package").repartition(n).mapInArrow(work, ddl(RECORDS))


def archive_roundtrip(pages: DataFrame) -> DataFrame:
    """Archives pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_packages(write_packages(plan_records(pages), folder), folder)
