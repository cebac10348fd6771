"""Packing of documents into fixed-length sequences by minimum bin slack.

A bin takes the longest piece left and then the fullest feasible combination of the lengths still
available, found by a subset-sum dynamic programme over one integer used as a bitset. All that the
search needs is how many pieces have each length, at most ``capacity`` numbers, whatever the
corpus; and a combination is used again as often as the counts allow, so the search ends after a number
of combinations that the capacity bounds, not the corpus. Which piece takes which place follows from
its rank among the pieces of its length, counted in salted groups.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from torrentine.llm.common import id_text, in_slices, materialize, sliced
from torrentine.llm.tokens import encoder

#: Pieces of text a worker remembers: fewer than elsewhere, as packing is a late stage whose workers share memory with what came before.
MEMO_PIECES = 300_000
#: Pieces of one length that are ranked in one task, about, however many there are.
RANK_ROWS = 10_000


def fullest(room: int, counts: list[tuple[int, int]]) -> dict[int, int]:
    """Lengths and how often to take each, for the largest total within ``room``; counts: (length, available), longest first."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length, available in counts:
        if length > room:
            continue
        left, part = min(available, room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            left -= part
            part *= 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + part
            total -= length * part
    return taken


def bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(first bin, number of bins, [(length, times)]) for each combination, by minimum bin slack."""
    left, found, first = {k: v for k, v in histogram.items() if v > 0}, [], 0
    order = sorted(left, reverse=True)
    while left:
        order = [k for k in order if k in left]
        top = order[0]
        counts = [(k, left[k] - (k == top)) for k in order]
        taken = fullest(capacity - top, counts) if capacity > top else {}
        taken[top] = taken.get(top, 0) + 1
        uses = min(left[k] // n for k, n in taken.items())
        found.append((first, uses, sorted(taken.items(), reverse=True)))
        first += uses
        for k, n in taken.items():
            left[k] -= uses * n
            if not left[k]:
                del left[k]
    return found


def places(found: list[tuple[int, int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first bin, times in a bin, offset of the first) in ascending rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    for first, uses, taken in found:
        at = 0
        for length, n in taken:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, first, n, at))
            used[length] = rank + uses * n
            at += length * n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, append ``end_id`` and cut only what is longer than ``capacity``.

    Null and empty texts are ``end_id`` alone; null identifiers and repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    end = struct.pack("<I", end_id)
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else PIECES

    def cut(batches):
        enc = encoder(tokenizer, MEMO_PIECES)

        def one():
            for batch in sliced(batches):
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist())):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        yield (doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), *([array("I", part).tolist()] if with_ids else []))

        yield from in_slices(one(), schema)

    return id_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on demand): one row a piece.

    Null and empty texts hold ``end_id`` alone. Repeated rows and rows with a null doc_id are
    documents of their own. Pieces of one length are alike to the search, so which of them takes which place is
    left to their order in the table of pieces. An empty table gives no rows. Other columns are not read.
    """
    # the row number is written with the pieces, so it stays what it is and deals out repeated rows like any others
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = places(bins(histogram, capacity))
    salts = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("_row"))
    ranked = salted.withColumn("rank", rank - 1).join(groups, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    cut = cut.drop("_row")
    names = cut.columns
    ranked = ranked.select(*names, "rank")

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                rows = where[int(k)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                seq[at] = row[:, 1] + (rank[at] - row[:, 0]) // row[:, 2]
                off[at] = row[:, 3] + (rank[at] - row[:, 0]) % row[:, 2] * k
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long")
