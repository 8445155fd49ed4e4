"""WARC archives compressed with Zstandard: written by tasks, read again a frame at a time.

An archive starts with a skippable frame that holds its dictionary (itself a
Zstandard frame, or plain), then has one frame per record.  Each archive trains
its dictionary on its own first records.  A task writes archives of at most about
``archive_bytes`` under names of its own and returns what it wrote; only the
archives of that written list count, so a task that is run again leaves at most
files that nobody reads.

Of records with equal payloads of at least ``least_bytes`` the one with the
largest page_id is a response and the others are revisits without payload, whose
HTTP header still says the payload's length.  The reader validates the version
line, the mandatory headers, the lengths of block and payload, the closing blank
lines and the payload's digest, and raises ``ValueError`` at what does not hold.

Cases: null html is an empty payload, a null url no target URI, a null page_id
no page header (null again when read; smallest where payloads are equal);
repeated rows of the largest page_id are all responses; a very long page is one
frame, held whole while it is written or read; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import shared_dir, written

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit carries the HTTP header of the page alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if record_type == "response" else b""
    head = {"WARC-Type": record_type, "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date, "Content-Type": "application/http; msgtype=response"}
    head |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()}
    head |= {"WARC-Target-URI": quote(url, safe="!#$%&'()*+,/:;=?@[]~")} if url is not None else {}
    head |= {"Page-Id": str(page_id)} if page_id is not None else {}
    if record_type == "revisit":
        head |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(refers_to, digest), "Refers-To-Page-Id": str(refers_to)}
    head |= {"Content-Length": str(len(block))}
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", block]) + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def decode(record: bytes) -> dict:
    """The record's fields, after validation."""
    top, blank, rest = record.partition(b"\r\n\r\n")
    version, *lines = top.split(b"\r\n")
    if version != VERSION or not blank:
        raise ValueError(f"not a record: {version[:40]!r}")
    head = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in head:
            raise ValueError(f"no header {name}")
    length = int(head["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes, said to be {length}")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no HTTP header")
    said = int(_headers(http.split(b"\r\n")[1:])["content-length"])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != said or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"a payload of {len(payload)} bytes, said to be {said} of digest {digest}")
    if kind == "revisit" and (payload or "warc-refers-to" not in head):
        raise ValueError("a revisit with a payload, or to nothing")
    number = lambda name: int(head[name]) if name in head else None
    return {"page_id": number("page-id"), "payload_bytes": said, "payload_digest": digest, "record_type": kind, "refers_to": number("refers-to-page-id"), "url": head.get("warc-target-uri"), "payload": payload}


def write_archive(stream, records: Iterator[bytes], dictionary_bytes: int = 16384, sample: int = 128, level: int = 3) -> int:
    """All records into one open stream; their number. The dictionary is trained on the first ``sample`` records."""
    first = [r for _, r in zip(range(sample), records)]
    try:
        dictionary = zstandard.train_dictionary(dictionary_bytes, first, k=256, d=8) if len(first) >= 16 else None
    except zstandard.ZstdError:  # samples too small or too alike for a dictionary
        dictionary = None
    packed = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes()) if dictionary else b""
    stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    frames, n = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True), 0
    for some in (first, records):
        for record in some:
            stream.write(frames.compress(record))
            n += 1
    return n


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open stream, one frame at a time; never more than a frame and a chunk in memory."""
    top = stream.read(8)
    if len(top) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack("<II", top)
    if magic != DICTIONARY_MAGIC:
        raise ValueError(f"starts with {magic:#x}, not with a dictionary frame")
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary is cut off")
    raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    data = stream.read(chunk)
    while data:
        frame, parts = frames.decompressobj(), []
        while not frame.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("a frame is cut off")
            parts.append(frame.decompress(data))
            data = b""
        data = frame.unused_data or stream.read(chunk)
        yield b"".join(parts)


def with_types(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to for each row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= least_bytes)
    # Groups of two and more, written first: Spark then knows their size, and moves the payloads only if they are many.
    groups = written(large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).filter("n > 1").select(F.col("digest").alias("_digest"), "kept"), "warc-groups")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    joined = rows.join(groups, F.col("digest") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = 1 << 30, date: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives under ``folder``; returns the written list (archive, records) of those that count."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        context, part, row = TaskContext.get(), 0, next(rows, None)
        while row is not None:
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{part:04d}-{uuid.uuid4().hex[:8]}.warc.zst"

            def some() -> Iterator[bytes]:
                nonlocal row
                size = 0
                while row is not None and size < archive_bytes:
                    record = encode(*row, date)
                    size += len(record)
                    row = next(rows, None)
                    yield record

            with fs.open_output_stream(f"{top}/{name}", compression=None) as stream:
                n = write_archive(stream, some())
            part += 1
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    return written(with_types(pages).mapInArrow(save, "archive string, records long"), "warc-list")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD for each record of the listed archives, validated; the payload is null unless ``payloads``."""
    n = max(1, archives.count())

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for record in read_archive(stream):
                        rows.append(decode(record) | ({} if payloads else {"payload": None}))
                        size += len(record) if payloads else 200
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in RECORD.split(", "))])
    return archives.select("archive").repartition(n).mapInArrow(load, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/panelyard/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder), payloads=False).drop("payload")
