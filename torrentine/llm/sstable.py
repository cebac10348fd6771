"""Token-ID output as sorted-string-table shards.

A shard holds documents in ascending identifier order: prefix-compressed entries in compressed
blocks, then a sparse index with one entry a block, a Bloom filter over the identifiers and a
footer of fixed size. A lookup reads the footer, asks the filter, finds the block by binary search
in the index and scans that block alone.

Layout: ``MAGIC block* index bloom footer``. An entry is ``shared, rest, width, n_ids`` (varints; width
2 or 4 bytes an id), the rest of the key, the ids. A key is nine bytes: 0 for a null identifier or 1,
then the identifier as big-endian with its sign bit flipped, so bytes sort as numbers do.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torrentine.llm.common import AtomicFile, id_text, in_slices, keep_tidy, open_fs, scratch_path
from torrentine.llm.tokens import MemoEncoder, encoder

MAGIC = b"TORRSST1"
FOOTER = struct.Struct("<QIQIIQQI8s")  # index at, length; bloom at, length, hashes; documents; ids; crc of index+bloom; magic
BLOCK_HEAD = struct.Struct("<III")  # raw length, stored length, crc32 of the raw block
INDEX_ENTRY = struct.Struct("<9sQQI")  # first key, place, ids before it in the shard, stored length with head


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, k: int, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(k)]


class Writer:
    """One shard; ``add`` takes ascending keys and ids as little-endian uint32 bytes."""

    def __init__(self, uri: str, block_bytes: int = 1 << 17, bits_per_key: int = 10):
        self.uri, self.file = uri, AtomicFile(uri)
        self.file.write(MAGIC)
        self.block_bytes, self.bits_per_key = block_bytes, bits_per_key
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys = bytearray()  # for the filter; nine bytes a document
        self.n_docs = self.n_ids = 0
        self._zip = zstandard.ZstdCompressor(level=1)
        self._start()

    def _start(self) -> None:
        self.block, self.first, self.last, self.before = bytearray(), None, b"", self.n_ids

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key, wide = key_of(doc_id), np.frombuffer(ids, "<u4")
        narrow = not len(wide) or int(wide.max()) < 1 << 16
        shared = 0
        for x, y in zip(key, self.last):
            if x != y:
                break
            shared += 1
        if self.first is None:
            self.first = key
        self.block += _varint(shared) + _varint(9 - shared) + _varint(2 if narrow else 4) + _varint(len(wide)) + key[shared:]
        self.block += wide.astype("<u2").tobytes() if narrow else ids
        self.last = key
        self.keys += key
        self.n_docs += 1
        self.n_ids += len(wide)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = self._zip.compress(bytes(self.block))
            self.index.append((self.first, self.file.size, self.before, len(stored) + BLOCK_HEAD.size))
            self.file.write(BLOCK_HEAD.pack(len(self.block), len(stored), zlib.crc32(self.block)))
            self.file.write(stored)
        self._start()

    def close(self) -> tuple[str, int, int]:
        self._flush()
        index = b"".join(INDEX_ENTRY.pack(*x) for x in self.index)
        bits, k = max(64, self.n_docs * self.bits_per_key), 7
        bloom = bytearray(bits + 7 >> 3)
        for i in range(0, len(self.keys), 9):
            for p in _probes(bytes(self.keys[i : i + 9]), k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_raw = struct.pack("<Q", bits) + bytes(bloom)
        at = self.file.size
        self.file.write(index)
        self.file.write(bloom_raw)
        self.file.write(FOOTER.pack(at, len(index), at + len(index), len(bloom_raw), k, self.n_docs, self.n_ids, zlib.crc32(index + bloom_raw), MAGIC))
        self.file.close()
        return self.uri, self.n_docs, self.n_ids


class Reader:
    """Reads a shard: ``scan`` streams block by block, ``get`` finds one identifier."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        tail = self._at(self.file.size() - FOOTER.size, FOOTER.size)
        at, n, bloom_at, bloom_n, self.k, self.n_docs, self.n_ids, crc, magic = FOOTER.unpack(tail)
        index, bloom = self._at(at, n), self._at(bloom_at, bloom_n)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError(f"{uri} is no whole shard")
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.index = list(INDEX_ENTRY.iter_unpack(index))
        self.firsts = [x[0] for x in self.index]
        self._unzip = zstandard.ZstdDecompressor()

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, _, n = self.index[i]
        raw_n, _, crc = BLOCK_HEAD.unpack(head := self._at(at, n)[: BLOCK_HEAD.size])
        raw = self._unzip.decompress(self._at(at + len(head), n - len(head)), max_output_size=raw_n)
        if zlib.crc32(raw) != crc:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            width, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            ids = raw[at : at + n * width]
            at += n * width
            yield key, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[bytes]:
        """Ids of every document of that identifier, in file order; none if it is absent."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.k, self.bits)):
            return []
        i, found = max(0, bisect.bisect_left(self.firsts, key) - 1), []
        while i < len(self.index) and self.firsts[i] <= key:
            found += [ids for k, ids in self._block(i) if k == key]
            i += 1
        return found


MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def encoded(batches: Iterator[pa.RecordBatch], enc: MemoEncoder, end: bytes) -> Iterator[tuple[int | None, bytes]]:
    """Identifiers and ids, ``end`` after those of each text, of batches of (doc_id, text); encoded by columns, so a word is looked up once in some megabytes."""
    keep_tidy()
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_column(batch.column(1))):
            yield doc_id, ids + end


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, shard_bytes: int = 64 << 20, block_bytes: int = 1 << 17) -> list[tuple[str, int, int]]:
    """Encode whole texts and write shards in ascending ``doc_id`` order; returns (path, documents, ids) of each shard in order.

    One range shuffle of (doc_id, text); each task sorts its range and streams it into shards of at
    most about ``shard_bytes`` of ids. What comes to the driver is one row a shard. Null texts are
    empty (their only id is ``end_id``); null identifiers sort first; rows of one identifier are kept
    all, ordered by text. An empty table gives no shards.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        part, enc, shard, seq, held = TaskContext.get().partitionId(), encoder(tokenizer), None, 0, 0
        for doc_id, ids in encoded(batches, enc, end):
            if shard is not None and held + len(ids) > shard_bytes:
                yield from in_slices(iter([(part, seq, *shard.close())]), MANIFEST)
                shard, seq, held = None, seq + 1, 0
            shard = shard or Writer(f"{path}/shard-{part:06d}-{seq:05d}.sst", block_bytes)
            shard.add(doc_id, ids)
            held += len(ids)
        if shard is not None:
            yield from in_slices(iter([(part, seq, *shard.close())]), MANIFEST)

    # by the start of the text too, so rows of one identifier, null above all, part where they are many
    ordered = id_text(docs).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(64))).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = ordered.mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long").collect()
    return [(r.path, r.n_docs, r.n_ids) for r in sorted(rows, key=lambda r: (r.part, r.seq))]


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark: SparkSession, shards: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """Read shards back: doc_id, start (ids before the document over all shards), n_tokens, ids_crc32, and the ids themselves on demand.

    One row for each document in the files: null identifiers and repeated rows as they were written; a list without shards gives no rows.
    """
    rows, start = [], 0
    for i, (path, _, n_ids) in enumerate(shards):
        rows.append((i, path, start))
        start += n_ids
    schema = READ.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else READ

    def read(batches):
        def one():
            for batch in batches:
                for path, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    for doc_id, ids in Reader(path).scan():
                        n = len(ids) // 4
                        yield (doc_id, at, n, zlib.crc32(ids), *([np.frombuffer(ids, "<u4").tolist()] if with_ids else []))
                        at += n

        yield from in_slices(one(), schema)

    listed = spark.createDataFrame(rows, "shard long, path string, at long")
    listed = listed.repartition(max(1, min(len(rows), 10_000)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_id_table(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards (in ``path``, else in the shared folder) and return what the files hold.

    Columns doc_id, start, n_tokens, ids_crc32. See :func:`write_shards` for nulls, ties and empty tables.
    """
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, tokenizer, path or scratch_path(spark, "sst"), end_id))
