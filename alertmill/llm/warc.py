"""WARC archives: written by Spark tasks, read back by a reader that salvages what a damaged file still holds.

Writing: a gzip member for each record, through Spark's own text writer (so that its commit protocol, any file system and
lost executors are its matter). That writer ends each row with a separator of at least one byte; the last byte of a gzip
member is the high byte of its length modulo 2^32, which is 0 under 16 MB. So rows leave that byte out and the separator
is a zero byte; a longer record is followed by an empty member, which ends in 0 too. The files are plain WARC files.

Salvage: a member or record that fails its checks (gzip CRC, version line, lengths, end mark, block digest) is left; the
search goes on for the next valid member or version line, and the bytes between are logged as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm.common import scratch_path, written

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
MEMBER_BYTES = 16_000_000
FILE_BYTES = 16_000_000
#: Of a file that Spark can read as one value, and of a record's headers.
MOST_BYTES, HEAD_BYTES = 1_900_000_000, 4096
DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record, not compressed. A revisit holds the HTTP head of its page, which tells the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not is_revisit:
        block += payload
    head = [f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"] if url is not None else []
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + END + block + END


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Found:
    """A record's headers, in lower case, and its block."""

    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]

    def http_length(self) -> int:
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", self.block.partition(END)[0])
        return int(m[1]) if m else len(self.payload)


@dataclass
class Salvage:
    """What a file holds: its records, and (begin, end, reason) of each gap. Inside a member, gaps are counted from its
    first byte, in the bytes it unpacks to, and named by the member's place."""

    records: list[Found] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def parse_record(data: bytes, at: int) -> tuple[Found, int] | str:
    """The valid record at a place and where it ends, or what is wrong with it."""
    m = re.compile(rb"WARC/[0-9]\.[0-9]\r\n").match(data, at)
    if not m:
        return "no version line"
    end = data.find(END, m.end())
    if end < 0:
        return "headers do not end"
    headers = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit() and len(size) < 19):
        return "bad length"
    begin = end + len(END)
    stop = begin + int(size)
    if data[stop : stop + len(END)] != END:
        return "no end mark"
    block = data[begin:stop]
    said = headers.get("warc-block-digest")
    if said and said.startswith("sha1:") and said[5:].upper() != base32(hashlib.sha1(block).digest()):
        return "block digest differs"
    return Found(headers, block), stop + len(END)


def salvage_plain(data: bytes) -> Salvage:
    """The valid records of bytes that are not compressed."""
    out, at, begin, why = Salvage(), 0, None, ""
    while at < len(data):
        got = parse_record(data, at)
        if isinstance(got, str):
            if begin is None:
                begin, why = at, got
            at = data.find(b"WARC/", at + 1)
            at = len(data) if at < 0 else at
            continue
        if begin is not None:
            out.gaps.append((begin, at, why))
            begin = None
        out.records.append(got[0])
        at = got[1]
    if begin is not None:
        out.gaps.append((begin, len(data), why))
    return out


def unpack(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """What the member at a place unpacks to and where it ends; None if it is damaged."""
    reader = zlib.decompressobj(31)
    parts = []
    step = 1 << 16
    try:
        for k in range(at, len(data), step):
            parts.append(reader.decompress(data[k : k + step]))
            if reader.eof:
                return b"".join(parts), min(k + step, len(data)) - len(reader.unused_data)
    except zlib.error:
        return None
    return None


def salvage(data: bytes) -> Salvage:
    """The valid records of a file of gzip members or of plain records; either may follow the other after damage."""
    out, at, begin, why = Salvage(), 0, None, ""
    view = memoryview(data)
    while at < len(data):
        got: tuple[list[Found], int] | str = "no member or version line"
        if data.startswith(MAGIC, at):
            if (unpacked := unpack(view, at)) is None:
                got = "damaged member"
            else:
                inner = salvage_plain(unpacked[0])
                got = inner.records, unpacked[1]
                out.gaps += [(a, b, f"in the member at {at}: {reason}") for a, b, reason in inner.gaps]
        elif data.startswith(b"WARC/", at):
            plain = parse_record(data, at)
            got = plain if isinstance(plain, str) else ([plain[0]], plain[1])
        if isinstance(got, str):
            if begin is None:
                begin, why = at, got
            places = [p for p in (data.find(MAGIC, at + 1), data.find(b"WARC/", at + 1)) if p >= 0]
            at = min(places, default=len(data))
            continue
        if begin is not None:
            out.gaps.append((begin, at, why))
            begin = None
        out.records += got[0]
        at = got[1]
    if begin is not None:
        out.gaps.append((begin, len(data), why))
    return out


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), n, sha1 (hex) and first_id, which is the least page_id of those with an equal payload.
    Rows that repeat a payload's least page_id are that page again, and so responses too; null ids come last.

    Digests are counted without their payloads (a row for each task), and only those that several rows share are written and
    joined: Spark sends them to all tasks if they are few, or else splits the rows of a frequent one."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    shared = own.filter(F.col("n") >= least_bytes).groupBy("sha1", "n").agg(F.min("page_id").alias("least"), F.count("*").alias("rows"))
    shared = written(shared.filter("rows > 1").select("sha1", "n", "least", F.lit(True).alias("shared")), "digests")
    first = F.when(F.col("shared"), F.col("least")).when(F.col("n") >= least_bytes, F.col("page_id"))
    return own.join(shared, ["sha1", "n"], "left").select("sha1", "n", "page_id", "url", "payload", first.alias("first_id"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """A record for each row of pages, in files of about file_bytes before compression. Files are cut by a number of records, from
    the mean size of a page; so many of the largest would still be under MOST_BYTES, so that each file can be read as one value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page_id, url, payload, base32(bytes.fromhex(sha1)), first, first is not None and first != page_id)
                packed = member(data)
                if len(data) >= MEMBER_BYTES:
                    packed += EMPTY_MEMBER
                out.append(packed[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["packed"])

    size = F.octet_length("html").cast("long")
    n, total, largest = pages.agg(F.count("*"), F.sum(size), F.max(size)).first()
    per_file = max(1, min(math.floor(file_bytes * n / max(total or 0, n, 1)), MOST_BYTES // ((largest or 0) + HEAD_BYTES)))
    rows = with_types(pages, least_bytes).select("page_id", "url", "payload", "sha1", "first_id")
    rows.mapInArrow(pack, "packed binary").select(F.col("packed").cast("string").alias("value")).write.options(lineSep="\0", maxRecordsPerFile=per_file).text(path)


READ = "file string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record that the archives of a folder hold; intact: a response's payload has the digest it names."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for r in salvage(content).records:
                    kind, h = r.headers.get("warc-type", ""), r.headers
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    number = [re.search(r"(-?[0-9]+)>$", h.get(name, "")) for name in ("warc-record-id", "warc-refers-to")]
                    ids = [int(m[1]) if m else None for m in number]
                    intact = kind != "response" or base32(hashlib.sha1(r.payload).digest()) == digest
                    rows.append((path, ids[0], r.http_length(), digest, kind, ids[1], intact))
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), types, strict=True)], names=names)

    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    return binary_files(spark, path).mapInArrow(parse, READ)


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """file, begin, end and reason of each byte gap that the reader leaves."""

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *g) for f, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for g in salvage(content).gaps]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "begin", "end", "reason"), r, strict=True)) for r in rows], pa.schema([("file", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]))

    return binary_files(spark, path).mapInArrow(gaps, "file string, begin long, end long, reason string")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them: page_id, payload_bytes, payload_digest, record_type
    and refers_to for each row. Null html is an empty payload; url and other columns may be anything."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    pages = pages if "url" in pages.columns else pages.withColumn("url", F.lit(None).cast("string"))
    write_archives(pages, path)
    read = read_archives(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))
