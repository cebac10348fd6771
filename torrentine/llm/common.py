"""Shared helpers of the training-data operators: shared storage, scratch tables, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a folder of its own, as driver and
    executors are one process there. On a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="torrentine-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/torrentine/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file on shared storage that shows under its name only when it is whole.

    A task that is repeated after an executor is lost, or runs twice by speculation, writes under a
    name of its own and moves that into place, so readers never see half a file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.tmp)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier (long) and the text: columns of any other name cannot clash further on."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Called now and then in a Python worker to give back what it no longer needs.
on_idle: list[Callable[[], None]] = []
_tidy: list[threading.Thread] = []


def keep_tidy(every_s: float = 3.0) -> None:
    """Within a task, starts a thread of the worker that returns free memory to the system.

    Workers outlive their tasks, and what a stage leaves in them counts against the stages after it.
    """
    if _tidy or TaskContext.get() is None:
        return

    def run():
        while True:
            time.sleep(every_s)
            for f in on_idle:
                f()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    _tidy.append(threading.Thread(target=run, daemon=True))
    _tidy[0].start()


def texts(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    keep_tidy()
    col = batch.column(i)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def sliced(batches, n: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``n`` rows, so that few rows at a time become Python objects."""
    keep_tidy()
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def in_slices(rows: Iterator[tuple], schema: pa.Schema, n: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows to record batches of at most ``n`` rows."""
    keep_tidy()
    buf: list[tuple] = []
    for row in rows:
        buf.append(row)
        if len(buf) >= n:
            yield to_batch(buf, schema)
            buf = []
    if buf:
        yield to_batch(buf, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")
