"""Token counts by a separator scan of flat, unindexed token files.

A file is nothing but ids of two bytes (four, if the vocabulary needs them), with an end-of-document id
after each document. Blocks of fixed size are read independently, each by one vectorised comparison; a
prefix scan over the blocks' separator counts and last separators numbers the documents and gives the
place where a document that began in an earlier block started.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from torrentine.llm.common import AtomicFile, id_text, in_slices, materialize, open_fs, scratch_path, sliced
from torrentine.llm.tokens import encoder

#: Bytes of a block.
BLOCK_BYTES = 8 << 20


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> DataFrame:
    """Encode whole texts into one flat file a task; returns (part, file, width, ordinal, doc_id) of each document.

    Null and empty texts are documents without ids before their end id; null identifiers and repeated rows are kept; tasks without rows
    write no file; other columns are not read. Names of special tokens are plain text, so the end id stands for nothing else.
    """
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("width", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def write(batches):
        part, enc, file, n = TaskContext.get().partitionId(), encoder(tokenizer, plain_specials=True), None, 0
        kind = "<u2" if max(len(enc.n_bytes) - 1, end_id) < 1 << 16 else "<u4"
        width, end, uri = int(kind[2]), np.array([end_id], kind).tobytes(), f"{path}/tokens-{part:06d}.bin"

        def one():
            nonlocal file, n
            for batch in sliced(batches):
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist())):
                    file = file or AtomicFile(uri)
                    file.write(np.frombuffer(ids, "<u4").astype(kind).tobytes() + end)
                    yield part, uri, width, n, doc_id
                    n += 1
            if file:
                file.close()

        yield from in_slices(one(), schema)

    return id_text(docs).mapInArrow(write, "part long, file string, width int, ordinal long, doc_id long")


def _sized(files: DataFrame) -> DataFrame:
    """Files with their sizes, asked for by the executors."""
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("width", pa.int32()), ("size", pa.int64())])

    def ask(batches):
        def one():
            for batch in batches:
                for row in batch.to_pylist():
                    fs, p = open_fs(row["file"])
                    yield row["part"], row["file"], row["width"], fs.get_file_info(p).size

        yield from in_slices(one(), schema)

    return files.select("part", "file", "width").mapInArrow(ask, "part long, file string, width int, size long")


def scan_flat(spark: SparkSession, files: DataFrame | list[tuple[int, str, int]], end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(part, ordinal, start, n_tokens, ended) of each document in flat files, given as (part, file, id width), a table or a list.

    start counts ids before the document in its file; the end id is not counted in n_tokens. Ids after the last
    separator are a document that has not ended. Empty files and an empty list give no rows. Blocks are listed in Spark, so
    nothing but their number comes to the driver.
    """
    if not isinstance(files, DataFrame):
        files = spark.createDataFrame(files, "part long, file string, width int")
    sized = materialize(_sized(files), "sizes").where("size > 0")
    n_blocks = sized.agg(F.sum(F.ceil(F.col("size") / block_bytes))).first()[0] or 0
    at = F.col("block") * block_bytes
    listed = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_bytes))).alias("block"))
    listed = listed.select("part", "file", "width", "block", at.alias("at"), F.least(F.lit(block_bytes).cast("long"), F.col("size") - at).alias("size"), (at + block_bytes >= F.col("size")).alias("final"))
    listed = listed.repartition(max(1, min(n_blocks, 10_000)))
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("seps", pa.list_(pa.int64())), ("tail", pa.int64())])

    def scan(batches):
        def one():
            for batch in batches:
                for row in batch.to_pylist():
                    fs, p = open_fs(row["file"])
                    with fs.open_input_file(p) as f:
                        f.seek(row["at"])
                        ids = np.frombuffer(f.read(row["size"]), f"<u{row['width']}")
                    first = row["at"] // row["width"]
                    yield row["part"], row["block"], first + np.flatnonzero(ids == end_id), first + len(ids) if row["final"] else None

        yield from in_slices(one(), schema, 1)

    found = listed.mapInArrow(scan, "part long, block long, seps array<long>, tail long")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "part",
        "seps",
        "tail",
        F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.max(F.array_max("seps")).over(before), F.lit(-1)).alias("sep_before"),
    )
    last = F.coalesce(F.array_max("seps"), F.col("sep_before"))
    ends = F.when(F.col("tail") > last + 1, F.concat("seps", F.array("tail"))).otherwise(F.col("seps"))
    rows = stitched.select("*", F.posexplode(ends).alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("sep_before")).otherwise(F.get("seps", F.col("i") - 1)) + 1
    return rows.select("part", (F.col("n_before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("i") < F.size("seps")).alias("ended"))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int = 50256, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens of each row of ``docs``, counted in flat token files that are written and scanned.

    Null and empty texts have no tokens. Null identifiers and repeated rows are kept; an empty table gives
    no rows; other columns are not read. The end id must be one that no text encodes to.
    """
    spark = docs.sparkSession
    listing = materialize(write_flat(docs, tokenizer, end_id, path or scratch_path(spark, "flat")), "listing")
    counted = scan_flat(spark, listing.select("part", "file", "width").distinct(), end_id, block_bytes)
    # both sides grow with the corpus and compress far below what they hold, so neither is broadcast
    return listing.join(counted.hint("merge"), ["part", "ordinal"]).select("doc_id", "n_tokens")
