"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package holds one WARC file of separately compressed records and an index of them, both
stored (not compressed again), as web archive collections are exchanged. The reader never
extracts a package. It reads the end of the file, follows the ZIP64 locator if there is one,
parses the central directory, finds the stored index and WARC members by their local headers,
and then reads each indexed record from its own byte range.

Of pages with equal payloads the one with the smallest page_id is a response; the others are
revisits, which name it and carry no payload.
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
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel.session import scratch_path

from .files import create, open_ranges
from .store import NO_ID, materialise, order_id, own_id, read

# A package is closed once its records fill so many bytes.
PACKAGE_BYTES = 32 << 20
WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_URN = "urn:page:"
_END_RECORD, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(lines: dict[str, object]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items()) + b"\r\n"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One compressed record: a response with its payload, or a revisit of another page."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers({"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    block = http + payload if refers_to is None else http
    lines: dict[str, object] = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_URN}{page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~"),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        lines |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_URN}{refers_to}>"}
    return _gzip(b"WARC/1.1\r\n" + _headers(lines) + block + b"\r\n\r\n")


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (lower-case names) and HTTP payload of one compressed record."""
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class PackageWriter:
    """Writes records to a package as they come; the index follows when it is closed."""

    def __init__(self, path: str):
        self.path, self.out = path, create(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(self._info(WARC_MEMBER), "w", force_zip64=True)
        self.index: list[bytes] = []
        self.size = 0
        self._add(_gzip(b"WARC/1.1\r\n" + _headers({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Length": 0}) + b"\r\n\r\n"))

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def _add(self, data: bytes) -> int:
        self.member.write(data)
        self.size += len(data)
        return self.size - len(data)

    def add(self, page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> None:
        data = record(page_id, url, payload, refers_to)
        place = {"filename": WARC_MEMBER, "offset": self._add(data), "length": len(data)}
        self.index.append(f"{_URN}{page_id} {json.dumps(place)}\n".encode())

    def close(self) -> int:
        """Completes the package; returns its number of records."""
        self.member.close()
        with self.zip.open(self._info(INDEX_MEMBER), "w", force_zip64=True) as out:
            out.writelines(sorted(self.index))
        self.zip.close()
        self.out.close()
        return len(self.index)


@dataclass
class Member:
    name: str
    method: int
    encrypted: bool
    size: int
    header: int


class PackageReader:
    """Reads byte ranges of a package's stored members."""

    def __init__(self, path: str):
        self.file = open_ranges(path)
        self.members = {m.name: m for m in self._central()}

    def _range(self, at: int, size: int) -> bytes:
        data = self.file.read_at(size, at)
        if len(data) != size:
            raise ValueError("the package ends early")
        return data

    def _central(self) -> Iterator[Member]:
        length = self.file.size()
        # The end record is followed by a comment of up to 65,535 bytes.
        tail_at = max(0, length - 22 - 65_535)
        tail = self._range(tail_at, length - tail_at)
        end = tail.rfind(_END_RECORD)
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail) if end + 22 <= len(tail) else end >= 0:
            end = tail.rfind(_END_RECORD, 0, end)
        if end < 0:
            raise ValueError("not a ZIP package")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        locator = tail_at + end - 20
        if locator >= 0 and self._range(locator, 4) == _LOCATOR64:
            (at64,) = struct.unpack_from("<Q", self._range(locator, 20), 8)
            record64 = self._range(at64, 56)
            if record64[:4] != _END64:
                raise ValueError("broken ZIP64 end record")
            count, size, at = struct.unpack_from("<QQQ", record64, 32)
        directory, place = self._range(at, size), 0
        for _ in range(count):
            if directory[place : place + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, place + 8)
            packed, plain, n, m, k = struct.unpack_from("<IIHHH", directory, place + 20)
            (header,) = struct.unpack_from("<I", directory, place + 42)
            name = directory[place + 46 : place + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            plain, packed, header = self._wide(directory[place + 46 + n : place + 46 + n + m], [plain, packed, header])
            yield Member(name, method, bool(flags & 1), packed, header)
            place += 46 + n + m + k

    @staticmethod
    def _wide(extra: bytes, values: list[int]) -> list[int]:
        """Sizes and place, from the ZIP64 field where they are too large for 32 bits."""
        at = 0
        while at + 4 <= len(extra):
            tag, size = struct.unpack_from("<HH", extra, at)
            if tag == 1:
                place = at + 4
                for i, value in enumerate(values):
                    if value == 0xFFFFFFFF:
                        (values[i],) = struct.unpack_from("<Q", extra, place)
                        place += 8
            at += 4 + size
        return values

    def start(self, member: Member) -> int:
        """Where a stored member's bytes begin, behind its local header."""
        if member.method != 0 or member.encrypted:
            raise ValueError(f"{member.name} is not stored as it is, so its records cannot be read by range")
        local = self._range(member.header, 30)
        if local[:4] != _LOCAL:
            raise ValueError("broken local header")
        return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))

    def records(self) -> Iterator[tuple[int, int]]:
        """Places and lengths in the package of all indexed records, in the order of places."""
        found = []
        starts: dict[str, int] = {}
        for name, member in self.members.items():
            if name.startswith("indexes/") and name.endswith(".cdxj"):
                for line in self._range(self.start(member), member.size).splitlines():
                    place = json.loads(line[line.index(b"{") :])
                    if place["filename"] not in starts:
                        starts[place["filename"]] = self.start(self.members[place["filename"]])
                    found.append((starts[place["filename"]] + place["offset"], place["length"]))
        return iter(sorted(found))

    def close(self) -> None:
        self.file.close()


def _packed(folder: str, limit: int):
    """Maps (page, url, html, refers_to) to the packages that the task wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "refers_to")), strict=True):
                if writer is None:
                    writer = PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                writer.add(page, url, (html or "").encode(), refers)
                if writer.size >= limit:
                    done.append((writer.path, writer.close()))
                    writer = None
        if writer is not None:
            done.append((writer.path, writer.close()))
        if done:
            paths, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return run


def write_packages(pages: DataFrame, folder: str | None = None, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Writes every page (page_id, url, html) as a record; returns path and records of each package.

    A null html is an empty payload, a null url an empty target. Pages that share the smallest
    id of their payload are all responses. A null page_id counts as the largest. A package that
    a failed task left is in no row of the result.
    """
    folder = folder or scratch_path(pages.sparkSession, "packages")
    # An own digest column, since rows that share an id may differ in payload.
    keyed = pages.select(order_id("page_id").alias("page"), "url", "html").withColumn("sha", F.sha1(F.coalesce("html", F.lit(""))))
    small = keyed.select("page", "sha")
    first = small.groupBy("sha").agg(F.min("page").alias("refers_to"))
    revisits = small.join(first, "sha").where("page > refers_to").distinct()
    joined = keyed.join(revisits, ["page", "sha"], "left").select("page", "url", "html", "refers_to")
    return materialise(joined.mapInArrow(_packed(folder, limit), "path string, records long"), "package-list")


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps package paths to their records."""
    names = ["page", "url", "record_type", "refers_to", "digest", "payload"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    for batch in batches:
        for path in batch.column("path").to_pylist():
            package, rows, size = PackageReader(path), [], 0

            def flush(rows: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

            for at, length in package.records():
                headers, payload = parse_record(package._range(at, length))
                refers = headers.get("warc-refers-to")
                rows.append((
                    int(headers["warc-record-id"].strip("<>").removeprefix(_URN)), headers["warc-target-uri"], headers["warc-type"],
                    int(refers.strip("<>").removeprefix(_URN)) if refers else None,
                    headers["warc-payload-digest"].removeprefix("sha1:"), payload,
                ))
                size += len(payload)
                if size > 8 << 20 or len(rows) >= 2000:
                    yield flush(rows)
                    rows, size = [], 0
            package.close()
            if rows:
                yield flush(rows)


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of the packages (column path): page, url, record_type, refers_to, digest, payload."""
    count = packages.count()
    spread = packages.select("path").repartition(max(1, count))
    return spread.mapInArrow(_read_records, "page long, url string, record_type string, refers_to long, digest string, payload binary")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the payload by its size, and the digest of a response by that of its payload."""
    for batch in batches:
        digests, sizes = batch.column("digest").to_pylist(), []
        for i, (kind, payload) in enumerate(zip(batch.column("record_type").to_pylist(), batch.column("payload"), strict=True)):
            if kind == "response":
                data = payload.as_py()
                digests[i] = digest_of(data)
                sizes.append(len(data))
            else:
                sizes.append(None)
        keep = [batch.column(c) for c in ("page", "record_type", "refers_to")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["page", "record_type", "refers_to", "digest", "size"])


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to packages and reads them back; a revisit's size is that of its response."""
    records = read_packages(write_packages(read(spark, sf_dir, "pages")))
    rows = records.mapInArrow(_measured, "page long, record_type string, refers_to long, digest string, size long")
    rows = materialise(rows, "records")
    responses = rows.where("record_type = 'response'").select(F.col("page").alias("refers_to"), "digest", F.col("size").alias("full")).distinct()
    found = rows.join(responses, ["refers_to", "digest"], "left")
    return found.select(
        own_id("page").alias("page_id"), F.coalesce("size", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.when(F.col("refers_to") != NO_ID, F.col("refers_to")).alias("refers_to"),
    )
