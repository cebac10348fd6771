"""WARC archives through a chunked record table.

A record is a run of rows (record, chunk number, bytes, digest so far). The writer turns a payload into
such rows as slices of the Arrow buffer and streams them into archives, one gzip member a record; the
reader turns archives into such rows again, with one chunk in memory however long the record is. Records are
read off the chunk table: their size and digest are those of the bytes in its rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torrentine.llm.common import AtomicFile, in_slices, keep_tidy, materialize, open_fs, scratch_path, to_batch

CHUNK = 1 << 18
#: Most bytes of chunks in a batch, about.
BATCH_BYTES = 4 << 20
#: Payloads below this are never revisits.
LEAST_REVISIT = 100
NAMES = uuid.UUID("6f1c7a52-6b0e-5d0c-9c0e-3f5f8f1a7e11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Chunk(NamedTuple):
    """One row of the chunked record table; digest and size cover the payload up to and with this chunk."""

    record_id: str
    chunk: int
    data: bytes | memoryview
    digest: str
    size: int
    last: bool


def chunks(record_id: str, payload, chunk_bytes: int = CHUNK) -> Iterator[Chunk]:
    """A payload as rows, each a slice without a copy; an empty payload is one empty row."""
    view, sha, size = memoryview(payload), hashlib.sha256(), 0
    for i, at in enumerate(range(0, max(1, len(view)), chunk_bytes)):
        part = view[at : at + chunk_bytes]
        sha.update(part)
        size += len(part)
        yield Chunk(record_id, i, part, sha.hexdigest(), size, at + chunk_bytes >= len(view))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def _line(name: str, value) -> str:
    return "" if value is None else f"{name}: {re.sub('[\r\n]+', ' ', str(value))}\r\n"


class ArchiveWriter:
    def __init__(self, uri: str, level: int = 1):
        self.uri, self.file, self.level, self.n = uri, AtomicFile(uri), level, 0

    def add(self, page_id: int | None, url: str | None, payload, size: int, digest: str, refers_to: int | None) -> None:
        """One record; of a revisit only the HTTP head is stored."""
        revisit = refers_to is not None
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        head = "WARC/1.1\r\n" + _line("WARC-Type", "revisit" if revisit else "response") + _line("WARC-Record-ID", me := record_id(page_id, digest))
        head += _line("WARC-Date", "2024-01-01T00:00:00Z") + _line("WARC-Target-URI", url) + _line("WARC-Payload-Digest", f"sha256:{digest}")
        if revisit:
            head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", record_id(refers_to, digest)) + _line("X-Refers-To-Page", refers_to)
        head += _line("X-Page-Id", page_id) + _line("Content-Type", "application/http; msgtype=response")
        head += _line("Content-Length", len(http) + (0 if revisit else size)) + "\r\n"
        gz = zlib.compressobj(self.level, wbits=31)
        self.file.write(gz.compress(head.encode() + http))
        for row in () if revisit else chunks(me, payload):
            self.file.write(gz.compress(row.data))
            if row.last and row.digest != digest:
                raise ValueError(f"the payload of {me} is not the one planned")
        self.file.write(gz.compress(b"\r\n\r\n") + gz.flush())
        self.n += 1

    def close(self) -> None:
        self.file.close()


class _Inflated:
    """Bytes of an archive, inflated as they are asked for; plain archives pass through."""

    def __init__(self, stream, step: int = CHUNK):
        self.stream, self.step, self.buf = stream, step, bytearray()
        self.raw = stream.read(step)
        self.gz = zlib.decompressobj(wbits=31) if self.raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.step)
        if not self.raw:
            return False
        if self.gz is None:
            self.buf += self.raw
            self.raw = b""
            return True
        self.buf += self.gz.decompress(self.raw, self.step)
        self.raw = self.gz.unconsumed_tail
        if self.gz.eof:
            self.raw = self.gz.unused_data
            self.gz = zlib.decompressobj(wbits=31)
        return True

    def head(self) -> list[str] | None:
        """Lines up to the next empty one; None at the end."""
        at = self.buf.find(b"\r\n\r\n")
        while at < 0:
            if not self.more():
                if bytes(self.buf).strip():
                    raise ValueError("the archive ends within a record")
                return None
            at = self.buf.find(b"\r\n\r\n")
        lines = self.buf[:at].decode().split("\r\n")
        del self.buf[: at + 4]
        return lines

    def take(self, n: int) -> bytes:
        while not self.buf:
            if not self.more():
                raise ValueError("the archive ends within a record")
        part = bytes(self.buf[:n])
        del self.buf[:n]
        return part


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], Chunk]]:
    """Header fields of the record and each row of its payload. A revisit has one row without bytes, whose size is the full payload's."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        src = _Inflated(stream)
        while (lines := src.head()) is not None:
            info = _fields(lines)
            left = int(info["content-length"])
            http_lines = src.head() or []
            left -= sum(len(x.encode()) + 2 for x in http_lines) + 2
            http = _fields(http_lines)
            me, digest = info["warc-record-id"], info["warc-payload-digest"].removeprefix("sha256:")
            if info["warc-type"] == "revisit":
                yield info, Chunk(me, 0, b"", digest, int(http["content-length"]), True)
            else:
                sha, size, i = hashlib.sha256(), 0, 0
                while left or not i:
                    part = src.take(min(left, CHUNK)) if left else b""
                    left -= len(part)
                    size += len(part)
                    sha.update(part)
                    if not left and sha.hexdigest() != digest:
                        raise ValueError(f"the payload of {me} is not the one written")
                    yield info, Chunk(me, i, part, sha.hexdigest(), size, not left)
                    i += 1
            end = src.take(4)
            while len(end) < 4:
                end += src.take(4 - len(end))
            if end != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, size, digest, refers_to: which record revisits which, before any is written.

    The digests that come twice are a table of their own, without payloads. Spark broadcasts it where it is small, so payloads stay
    where they were read; where it is not, both sides of the join are plain shuffles, of which adaptive execution splits a hot digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    known = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("lead"), F.count(F.lit(1)).alias("n"))
    leads = materialize(known.where("n > 1 and lead is not null").select(F.col("digest").alias("d"), "lead"), "leads")
    follows = (F.col("size") >= LEAST_REVISIT) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("lead")))
    return rows.join(leads, (F.col("digest") == F.col("d")) & follows, "left").withColumnRenamed("lead", "refers_to").drop("d")


def write_archives(pages: DataFrame, path: str, archive_records: int = 100_000) -> list[str]:
    """Write a record for every row of ``pages``; the archives' places, one a task or ``archive_records`` records."""
    out = pa.schema([("path", pa.string()), ("n", pa.int64())])

    def write(batches):
        part, seq, archive, found = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            page_ids, urls, sizes, digests, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "size", "digest", "refers_to"))
            payload = batch.column("payload")
            for i, page_id in enumerate(page_ids):
                archive = archive or ArchiveWriter(f"{path}/part-{part:06d}-{seq:05d}.warc.gz")
                archive.add(page_id, urls[i], payload[i].as_buffer(), sizes[i], digests[i], refers[i])
                if archive.n >= archive_records:
                    archive.close()
                    found.append((archive.uri, archive.n))
                    archive, seq = None, seq + 1
        if archive:
            archive.close()
            found.append((archive.uri, archive.n))
        yield from in_slices(iter(found), out)

    return sorted(r.path for r in plan(pages).mapInArrow(write, "path string, n long").collect())


def by_bytes(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunk rows, whose last column is the data, to batches of about ``BATCH_BYTES``."""
    keep_tidy()
    buf, held = [], 0
    for row in rows:
        buf.append(row)
        held += len(row[-1]) + 512
        if held >= BATCH_BYTES:
            yield to_batch(buf, schema)
            buf, held = [], 0
    if buf:
        yield to_batch(buf, schema)


def read_archives(spark: SparkSession, paths: list[str], with_data: bool = False) -> DataFrame:
    """The chunked record table of archives: record_id, page_id, url, record_type, refers_to, chunk, digest, size, last, and data on demand."""
    kinds = [("record_id", "string"), ("page_id", "long"), ("url", "string"), ("record_type", "string"), ("refers_to", "long"), ("chunk", "long"), ("digest", "string"), ("size", "long"), ("last", "boolean")]
    kinds += [("data", "binary")] * with_data
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in kinds])
    number = lambda x: None if x is None else int(x)

    def read(batches):
        def one():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    for info, c in read_archive(path):
                        row = c.record_id, number(info.get("x-page-id")), info.get("warc-target-uri"), info["warc-type"], number(info.get("x-refers-to-page")), c.chunk, c.digest, c.size, c.last
                        yield (*row, c.data) if with_data else row

        yield from by_bytes(one(), schema) if with_data else in_slices(one(), schema)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 10_000)))
    return listed.mapInArrow(read, ", ".join(f"`{n}` {t}" for n, t in kinds))


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def records(chunk_table: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of a chunk table with data, as :func:`read_archives` gives it.

    Size and digest are those of the bytes in the record's rows, which follow each other in one partition; of a revisit, those that it
    states. A row that is out of place, or whose digest so far is not that of the bytes so far, is an error.
    """
    names = ("record_id", "page_id", "record_type", "refers_to", "chunk", "digest", "size", "last")

    def fold(batches):
        def one():
            me, sha, size, n = None, None, 0, 0
            for batch in batches:
                data = batch.column("data")
                for i, (rid, page_id, kind, refers, chunk, digest, total, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                    if chunk == 0:
                        me, sha, size, n = rid, hashlib.sha256(), 0, 0
                    if rid != me or chunk != n:
                        raise ValueError(f"chunk {chunk} of {rid} is out of place")
                    part = data[i].as_buffer()
                    sha.update(part)
                    size, n = size + part.size, n + 1
                    if kind != "revisit" and (size != total or sha.hexdigest() != digest):
                        raise ValueError(f"chunk {chunk} of {rid} is not the one written")
                    if last:
                        yield page_id, total, digest, kind, refers

        yield from in_slices(one(), RECORDS)

    return chunk_table.mapInArrow(fold, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of ``pages``, from archives written and read back.

    A null html is an empty payload. Of equal payloads of at least 100 bytes the one with the smallest
    page_id is the response and all others revisit it; repeated rows of that page_id are responses too. Rows
    with a null page_id never lead a group. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    return records(read_archives(spark, write_archives(pages, path or scratch_path(spark, "warc")), with_data=True))
