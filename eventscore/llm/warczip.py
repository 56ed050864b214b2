"""WARC records in ZIP archives: written with stored members and an index, read by ranges without extraction.

An archive holds archive/data.warc.gz (one gzip member a record) and indexes/index.cdxj (a line a record with offset
and length), both stored. The reader parses the end record, the ZIP64 records and the central directory, finds the
stored members, and reads single records by byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, open_store

LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or for a payload that stands elsewhere a revisit record without it, as a gzip member."""
    name = "null" if page_id is None else str(page_id)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    raw = "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields, names in lower case, and the block of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this range")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4:
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


class ZipWriter:
    """One archive to a sink that only moves forward. Sizes follow a member's data, so records stream through."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.at, self.members, self.zip64 = sink, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> None:
        raw, start, crc, size = name.encode(), self.at, 0, 0
        # version 4.5, flag 3: sizes and checksum stand after the data, as eight-byte numbers (ZIP64)
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            self._put(part)
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append((raw, start, crc, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            big = self.zip64 or max(at, size) >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            small = (0xFFFFFFFF,) * 3 if big else (size, size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 33, crc, small[0], small[1], len(raw), len(extra), 0, 0, 0, 0, small[2]) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or max(self.at, start) >= 0xFFFFFFFF:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", LOCATOR, 0, end, 1))
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


class ZipReader:
    """Members of an archive by byte ranges. `members`: name -> (first byte of the data, size); only stored ones can be read."""

    def __init__(self, source, size: int):
        self.source, self.bytes_read, self.members = source, 0, {}
        tail_at = max(0, size - 65557)
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(struct.pack("<I", END))
        if end < 0:
            raise ValueError("no ZIP archive: no end of central directory")
        _, _, _, _, n, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, end)
        if 0xFFFFFFFF in (length, start) or n == 0xFFFF:
            kind, _, at, _ = struct.unpack("<IIQI", self.range(tail_at + end - 20, 20))
            if kind != LOCATOR:
                raise ValueError("no ZIP64 locator")
            kind, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", self.range(at, 56))
            if kind != END64:
                raise ValueError("no ZIP64 end record")
        directory, p = self.range(start, length), 0
        for _ in range(n):
            kind, _, _, _, method, _, _, _, packed, plain, a, b, c, _, _, _, at = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
            if kind != CENTRAL:
                raise ValueError("the central directory is damaged")
            name, extra = directory[p + 46 : p + 46 + a].decode(), directory[p + 46 + a : p + 46 + a + b]
            p += 46 + a + b + c
            while len(extra) >= 4:
                tag, m = struct.unpack_from("<HH", extra)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                    plain, packed, at = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, at))
                extra = extra[4 + m :]
            if method == 0 and packed == plain:
                self.members[name] = (at, plain)
        self._starts: dict[str, int] = {}

    def range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the archive is cut short")
        self.bytes_read += n
        return data

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        """A range of a stored member."""
        head, size = self.members[name]
        if name not in self._starts:
            kind, *_, a, b = struct.unpack("<IHHHHHIIIHH", self.range(head, 30))
            if kind != LOCAL:
                raise ValueError("no member at the place that the directory names")
            self._starts[name] = head + 30 + a + b
        n = size - at if n is None else n
        if at < 0 or n < 0 or at + n > size:
            raise ValueError("the range lies outside the member")
        return self.range(self._starts[name] + at, n)

    def index(self, piece: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """(offset, length) of every record, from the index members, read in pieces."""
        for name in sorted(x for x in self.members if x.startswith("indexes/")):
            rest, at, size = b"", 0, self.members[name][1]
            while at < size:
                chunk = rest + self.read(name, at, min(piece, size - at))
                at += min(piece, size - at)
                *lines, rest = chunk.split(b"\n")
                for line in lines:
                    x = json.loads(line.split(b" ", 2)[2])
                    yield int(x["offset"]), int(x["length"])


def revisits(pages: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(digest, first) of payloads of at least `least` bytes that stand in several rows: the smallest page_id."""
    found = pages.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    found = found.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    return scratch.table(found.select(F.col("sha").alias("_sha"), "first"), "first")


def write_archives(pages: DataFrame, spark: SparkSession, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, archive_bytes: int = 1 << 28, zip64: bool = False, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes a record a row into archives of about archive_bytes; the manifest (path, bytes, records) and the folder.

    Of rows with equal payloads of at least `least` bytes those with the smallest id are responses, others revisits of
    it. Null html: an empty payload. A null id is never a revisit's target, and of equal payloads revisits the smallest
    id as any other row; without any id all are responses. Rows of equal id and payload count each.
    A failed attempt's files have names of their own that no manifest mentions.
    """
    scratch = Scratch(spark, "warc")
    folder = folder or f"{scratch.path}/archives"
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    first = revisits(rows, scratch, least)
    told = rows.join(first, F.sha1("payload") == F.col("_sha"), "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        out, base_path = open_store(folder)
        rows = (r for b in batches for r in zip(*(b.column(i) for i in range(4)), strict=True))
        ahead = next(rows, None)
        while ahead is not None:
            path = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.wacz"
            index: list[bytes] = []

            def records() -> Iterator[bytes]:
                nonlocal ahead
                at = 0
                while ahead is not None and at < archive_bytes:
                    page_id, url, payload, refers = (x.as_py() for x in ahead)
                    data = record(page_id, url, payload, refers)
                    index.append(f"page:{page_id} 19700101000000 ".encode() + json.dumps({"offset": at, "length": len(data)}).encode() + b"\n")
                    at += len(data)
                    yield data
                    ahead = next(rows, None)

            with out.open_output_stream(f"{base_path}/{path}", compression=None) as sink:
                z = ZipWriter(sink, zip64)
                z.member(DATA, records())
                z.member(INDEX, iter(index))
                z.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [z.at], "records": [len(index)]})
            seq += 1

    return scratch.table(told.mapInArrow(run, "path string, bytes long, records long"), "manifest"), folder


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, by index and range: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A response whose payload fails its digest raises."""

    def page(name: str | None) -> int | None:
        name = name and name.removeprefix("<urn:page:").removesuffix(">")
        return None if name in (None, "null") else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(f"{base}/{row['path']}") as source:
                    z, found = ZipReader(source, row["bytes"]), []
                    for at, n in z.index():
                        head, block = parse(z.read(DATA, at, n))
                        sha, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        if head["warc-type"] == "response" and (digest(block), len(block)) != (sha, size):
                            raise ValueError(f"{row['path']}: a payload at {at} fails its digest")
                        found.append((page(head["warc-record-id"]), size, sha, head["warc-type"], page(head.get("warc-refers-to"))))
                        if len(found) == 10_000:
                            yield batch(found)
                            found = []
                    yield batch(found)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = {"page_id": "i8", "payload_bytes": "i8", "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": "i8"}
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    # a number of partitions, or else Spark merges these small rows into one task
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "bytes").repartition(parts, "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_table(pages: DataFrame, spark: SparkSession, **how) -> DataFrame:
    """Writes pages into archives and reads every record back."""
    manifest, folder = write_archives(pages, spark, **how)
    return read_archives(manifest, folder)
