"""Packing by concatenating and cutting: documents laid end to end, fixed windows, records of the borders.

The first pass encodes each document once and notes where it starts within its partition; the totals of
the partitions, one number each, then give every partition its place in the whole stream, by a prefix
sum. The second pass knows a document's place in the stream and so cuts it at the windows' borders on its
own: no row moves, whatever the sizes of documents or partitions.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from torrentine.llm.common import id_text, in_slices, materialize, sliced
from torrentine.llm.tokens import encoder

ENCODED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
RECORDS = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, part, before, n_tokens and ids (little-endian unsigned 32-bit), where ``before`` counts the ids of the same partition so far."""
    end = struct.pack("<I", end_id)

    def encode(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()

        def rows():
            before = 0
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_column(batch.column(1))):
                    ids += end
                    yield doc_id, part, before, len(ids) // 4, ids
                    before += len(ids) // 4

        yield from in_slices(rows(), ENCODED, 128)

    return id_text(docs).mapInArrow(encode, "doc_id long, part int, before long, n_tokens long, ids binary")


def part_offsets(table: DataFrame) -> DataFrame:
    """part, base: how many ids lie in earlier partitions. A row for each partition of the scan, so the one task of the window is small."""
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))


def concat_and_cut(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on demand): one row a piece.

    Every sequence but the last holds exactly ``capacity`` ids, so at most ``capacity`` - 1 places of the whole corpus
    are padding. Null and empty texts hold ``end_id`` alone. Repeated rows and rows with a null doc_id are documents of
    their own. Documents follow each other in the order of the scan. An empty table gives no rows. Other columns are not read.
    """
    table = materialize(encoded(docs, tokenizer, end_id), "concat-ids")
    schema = RECORDS.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else RECORDS
    bases = {r.part: r.base for r in part_offsets(table).collect()}  # one number a partition
    shared = table.sparkSession.sparkContext.broadcast(bases)

    def cut(batches):
        def rows():
            for batch in sliced(batches, 128):
                for doc_id, part, before, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "before", "ids"))):
                    at, n, start = shared.value[part] + before, len(ids) // 4, 0
                    while start < n:
                        seq, offset = divmod(at + start, capacity)
                        length = min(n - start, capacity - offset)
                        piece = ids[4 * start : 4 * (start + length)]
                        yield (doc_id, start, length, zlib.crc32(piece), n, seq, offset, *([array("I", piece).tolist()] if with_ids else []))
                        start += length

        yield from in_slices(rows(), schema, 512 if with_ids else 4096)

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return table.mapInArrow(cut, columns + ", ids array<long>" * with_ids)


def sequences(pieces: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_ids, padding, bounds from pieces with ids: what a training loader reads.

    ``bounds`` has (offset, length, doc_id, start) of each piece in order. A sequence is padded with ``pad_id`` to
    ``capacity`` unless its length is a power of two. A group is one sequence, ``capacity`` pieces at most.
    """
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    short = F.when(F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0, 0).otherwise(capacity - F.col("n_ids")).cast("int")
    return (
        whole.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), n.alias("n_ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("bounds"))
        .withColumn("padding", short)
        .withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), F.col("padding"))))
        .select("sequence_id", "ids", "n_ids", "padding", "bounds")
    )
