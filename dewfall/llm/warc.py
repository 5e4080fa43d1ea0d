"""WARC archives of web pages, compressed record by record with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of records and stands, in a skippable frame, at the
head of every archive; each record is then a frame of its own, so any record can be read alone.
Of pages with equal payloads one is a response, the others are revisit records without payload.

Spark writes and reads the files, so they may lie in any store that it knows, and its committer keeps those of lost or repeated tasks out.
The text writer puts a row's bytes down as they are; what it sets between rows is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dewfall.llm.common import hash_sample, hot_bound, written

#: Skippable frame that holds the dictionary.
MAGIC = 0x184D2A5D
#: An empty skippable frame; all its bytes are plain characters, so it can be a line separator.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode()
#: Bytes at which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is fitted on at most so many payloads, each cut to so many bytes, and is this large.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 1_000, 8_192, 65_536
#: Date of every record; a parameter, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def uri_line(name: str, value: str) -> str:
    """A header line for a URI. One with control characters or blanks at its ends goes percent-encoded, under a name that says so."""
    if value != value.strip() or any(ord(c) < 0x20 or c == "\x7f" for c in value):
        return f"{name}-Encoded: {quote(value, safe='')}"
    return f"{name}: {value}"


def uri_of(headers: dict[str, str], name: str) -> str | None:
    encoded = headers.get(f"{name}-encoded")
    return headers.get(name) if encoded is None else unquote(encoded)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record: HTTP headers, and for a response the payload."""
    digest = b32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Block-Digest: sha1:{b32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(uri_line("WARC-Target-URI", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        head.append(f"WARC-Refers-To-Page-ID: {'' if refers_to is None else refers_to}")
        if refers_url is not None:
            head.append(uri_line("WARC-Refers-To-Target-URI", refers_url))
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream; one record is in memory at a time."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record is cut short")
        yield headers, block


def compressor(dictionary: bytes, level: int = 6) -> zstandard.ZstdCompressor:
    """With a trained dictionary, or bytes that stand for one as they are; an empty one is none."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive's bytes."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ValueError("an archive without a dictionary frame")
    (n,) = struct.unpack_from("<I", data, 4)
    dictionary = data[8 : 8 + n]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    yield from parse_records(io.BufferedReader(reader.stream_reader(memoryview(data)[8 + n :], read_across_frames=True), 1 << 20))


def train_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS, size: int = DICT_BYTES) -> bytes:
    """From `records` records, picked by hash, with at most SAMPLE_BYTES of payload each.

    Too small or too uniform a sample cannot be trained on; then records of the sample themselves are the dictionary. No pages give none."""
    rows = (
        hash_sample(pages.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")), records, "page_id", "url").collect()
    )
    samples = [build_record(r.page_id, r.url, (r.html or "").encode(), None, None, False) for r in rows]
    try:
        if len(samples) >= 8:
            return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 20)), samples).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples)[-size:]


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with digest, first_id and first_url: of the equal payloads' rows the one with the smallest page_id.

    Payloads below min_bytes are never compared: first_id is null there, as for a payload that occurs once."""
    html = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"digest": F.sha1(F.encode("html", "utf-8")), "bytes": F.octet_length("html").cast("long")}
    )
    # Rows without an id order last; ties go to the smaller URL.
    key = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    groups = written(
        sized.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads"
    )
    hot = groups.where(F.col("n") > hot_bound(groups))  # one payload on very many pages; few at most, see hot_bound
    cold = sized.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.drop("n"), "digest", "left")
    planned = cold if hot.isEmpty() else cold.unionByName(sized.join(F.broadcast(hot.drop("n")), "digest"))
    return planned.withColumn("same", key.eqNullSafe(F.col("first")))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, dictionary: bytes | None = None) -> DataFrame:
    """Writes archives into `folder`, which must not exist, and returns (path, bytes) of them.

    Needs page_id, url, html; a null html is an empty payload, a null url gives no target URI. Rows that equal
    the response in page_id, url and payload are responses too; rows without page_id order last among equal payloads. A task closes an archive at about ARCHIVE_BYTES
    and begins the next, so an archive and a record are what it holds. An empty table writes no archive."""
    shared = train_dictionary(pages) if dictionary is None else dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, head = compressor(shared), archive_head(shared)
        parts, size = [head], len(head)
        for batch in batches:
            for page_id, url, html, revisit, to, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(pack.compress(build_record(page_id, url, (html or "").encode(), to, to_url, revisit)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
                    parts, size = [head], len(head)
        if len(parts) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])

    planned = plan_records(pages, min_bytes)
    revisit = F.col("first").isNotNull() & ~F.col("same")
    rows = planned.select(
        "page_id", "url", "html",
        revisit.alias("revisit"),
        F.when(revisit, F.col("first.page_id")).alias("to"),
        F.when(revisit, F.col("first.url")).alias("to_url"),
    )
    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(folder)
    return files(pages.sparkSession, folder).select("path", F.col("length").alias("bytes"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives in a folder, with their content; a file without any bytes, as an empty table leaves it, is none."""
    return spark.read.format("binaryFile").load(folder).where("length > 0")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in `folder`, with digests checked against the blocks. A task reads whole archives, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows: list[tuple] = []
                for head, block in read_archive(batch.column(0)[k].as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length:")[2])
                    revisit = head["warc-type"] == "revisit"
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    ok = head["warc-block-digest"] == f"sha1:{b32_sha1(block)}" and (revisit or (len(payload) == size and b32_sha1(payload) == digest))
                    number = lambda name: int(head[name]) if head.get(name) else None  # noqa: B023, E731
                    rows.append((number("warc-page-id"), uri_of(head, "warc-target-uri"), size, digest, head["warc-type"], number("warc-refers-to-page-id"), ok))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    found = files(spark, folder)
    # a file to a task: a batch of many archives would be held at once
    return found.select("content", "path").repartition(max(1, found.count()), "path").select("content").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=names)
