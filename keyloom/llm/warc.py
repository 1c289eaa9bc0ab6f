"""WARC archives in seekable Zstandard bundles.

Records are put together in frames that are compressed on their own; a seek table in a skippable frame at
the end (the public seekable format) gives the sizes of all frames. The index maps each record
identifier to its archive, frame and offset inside the decompressed frame, so one record is read by
fetching the seek table and one frame.

Records whose payloads are equal (SHA-1 and length) are written once in full, by the row with the largest
id; the others are revisit records that name it. Ids that are null are revisited by nobody. A null
payload is an empty one; repeated rows become records each (of rows with the largest id and equal
payloads, all are full); an empty table gives no archive; a payload longer than a frame is a frame of its own; further columns are not
read.

Reading goes by the index: its entries are put together by frame, frames are dealt over the tasks in short runs, and a task fetches an
archive's seek table and those frames only. Each record is parsed at its offset.

A task writes its archives under names of its own and only then reports them, so what a lost attempt
wrote is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

#: Bytes of records in a frame, and compressed bytes of an archive, from which the next one begins.
FRAME, ARCHIVE = 1 << 20, 256 << 20
LEVEL = 6
#: Neighbouring frames that one task reads; such runs in a task.
RUN, RUNS = 16, 4
DATE = "1970-01-01T00:00:00Z"
# fixed values of the public seekable format
SKIPPABLE, SEEKABLE, ENTRY, FOOTER = 0x184D2A5E, 0x8F92EAB1, struct.Struct("<II"), struct.Struct("<IBI")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:record:{key}>" if key is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _header(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    """White space and control characters would end the header field."""
    return None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (headers only) if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Key", None if key is None else str(key)),
    ]
    if refers_to is None:
        return _header(fields, http + payload)
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Key", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    return _header(fields + more, http)


def parse(frame: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of a decompressed frame, from an offset on."""
    while at < len(frame):
        head = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:head].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        yield at, fields, frame[head + 4 : head + 4 + n]
        at = head + 4 + n + 4


class Bundle:
    """Writes records into frames of a file and the seek table after them."""

    def __init__(self, out, frame: int = FRAME):
        self.out, self.limit = out, frame
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.n = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.n and self.n + len(data) > self.limit:
            self.flush()
        place = len(self.sizes), self.n
        self.held.append(data)
        self.n += len(data)
        return place

    def flush(self) -> None:
        if self.n:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.n))
            self.written += len(packed)
            self.held, self.n = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(ENTRY.pack(*x) for x in self.sizes) + FOOTER.pack(len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Archive:
    """Reads a bundle by its seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, flags, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError("no seek table, or one with checksums")
        table = file.read_at(n * ENTRY.size, size - FOOTER.size - n * ENTRY.size)
        self.sizes = [ENTRY.unpack_from(table, i * ENTRY.size) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, i: int) -> bytes:
        packed, n = self.sizes[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[i]), n)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return next(parse(self.frame(frame), offset))[1:]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; Spark's names of S3 are the library's s3."""
    scheme, colon, rest = uri.partition(":")
    return pafs.FileSystem.from_uri("s3:" + rest if colon and scheme in ("s3a", "s3n") else uri)


def open_archive(path: str) -> Archive:
    fs, at = file_system(path)
    return Archive(fs.open_input_file(at))


def with_references(pages: DataFrame, scratch: Scratch, key: str, url: str, payload: str, least: int = 0) -> DataFrame:
    """key, url, payload and refers_to (the row that has the payload in full, null if it is this one)."""
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), text.alias("payload"), F.sha1(text).alias("sha1"), F.octet_length(text).alias("n"))
    # counted in each task first: a payload that many rows share is no hot key here
    shared = rows.where(F.col("n") >= least).groupBy("sha1", "n").agg(F.max("key").alias("full"), F.count("*").alias("copies")).where("copies > 1 and full is not null")
    shared = scratch.table(shared.select("sha1", "n", "full"), "shared")
    # here it is; both sides are plain scans, so adaptive execution splits it
    return rows.join(shared, ["sha1", "n"], "left").select("key", "url", "payload", F.when(F.col("key").isNull() | (F.col("key") != F.col("full")), F.col("full")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, frame: int = FRAME, archive: int = ARCHIVE) -> DataFrame:
    """Writes the rows of with_references as archives; gives the index: key, archive, frame, offset, length."""
    bound_batches(rows.sparkSession)

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        bundle = name = None
        index: list[tuple] = []

        def opened():
            name = f"{uuid.uuid4().hex}.warc.zst"
            b = Bundle(fs.open_output_stream(f"{base}/{name}", compression=None), frame)
            b.add(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            return b, name

        def done():
            bundle.close()
            keys, frames, offsets, lengths = zip(*index, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([f"{folder}/{name}"] * len(keys)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "archive", "frame", "offset", "length"])

        for b in batches:
            for r in b.to_pylist():
                if bundle is None:
                    bundle, name = opened()
                    index = []
                payload = r["payload"].encode()
                data = record(r["key"], r["url"], payload, payload_digest(payload), r["refers_to"])
                index.append((r["key"], *bundle.add(data), len(data)))
                if bundle.written >= archive:
                    yield done()
                    bundle = None
        if bundle is not None:
            yield done()

    return rows.select("key", "url", "payload", "refers_to").mapInArrow(run, "key long, archive string, frame int, offset long, length long")


RECORDS = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string, frame int, offset long"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64()]


def _records(path: str, frame: int, found: Iterator[tuple[int, dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of the response and revisit records among those found in a frame."""
    out = []
    for at, f, block in found:
        if f["WARC-Type"] not in ("response", "revisit"):
            continue
        digest, refers = f["WARC-Payload-Digest"].removeprefix("sha1:"), f.get("X-Refers-To-Key")
        payload = None
        if f["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if payload_digest(payload) != digest:
                raise ValueError(f"{path}, frame {frame}, offset {at}: the payload doesn't match its digest")
        n = len(payload) if payload is not None else int(f["X-Payload-Length"])
        out.append((int(f["X-Key"]) if "X-Key" in f else None, f.get("WARC-Target-URI"), n, digest, f["WARC-Type"], int(refers) if refers else None, payload, path, frame, at))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each response and revisit record of the archives named in the column ``archive``, whose index needn't be known.

    Payloads of responses are checked against their digests.
    """

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                a = open_archive(path)
                for i in range(len(a.sizes)):
                    yield from _records(path, i, parse(a.frame(i)))

    return archives.select("archive").mapInArrow(run, RECORDS)


def read_index(index: DataFrame) -> DataFrame:
    """The same for the records of an index (archive, frame, offset), which may be any part of one; only their frames are fetched."""
    spark = index.sparkSession
    # a frame has as many records as fit in FRAME bytes, or one
    frames = index.groupBy("archive", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    runs = index.agg(F.count_distinct("archive", F.floor(F.col("frame") / RUN))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs // RUNS)

    def run(batches):
        a, name = None, None
        for b in batches:
            for path, frame, offsets in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != name:
                    a, name = open_archive(path), path
                data = a.frame(frame)
                yield from _records(path, frame, (next(parse(data, at)) for at in offsets))

    dealt = frames.repartition(n, "archive", F.floor(F.col("frame") / RUN)).sortWithinPartitions("archive", "frame")
    return dealt.select("archive", "frame", "offsets").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes all rows as archives in scratch, reads them back by the index, and gives key, payload_bytes, payload_digest, record_type, refers_to, frame, offset."""
    with Scratch(pages.sparkSession) as s:
        index = s.table(write_archives(with_references(pages, s, key, url, payload, least), s.path("archives")), "index")
        return s.keep(read_index(index).select(F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to", "frame", "offset"))
