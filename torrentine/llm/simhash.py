"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; the counts of set bits in them are a
point of a 32-dimensional grid. A changed bit moves one coordinate by at most one, so the Manhattan
distance of two points is never above the Hamming distance of their fingerprints. The coordinates are dealt into blocks; points within
Manhattan distance k differ in at most k blocks, so they share a cell of the grid over all other blocks. Each point lives in one
cell for each choice of those blocks. Candidates of a cell pass the Manhattan bound over all coordinates, then the exact
Hamming distance, inside the join; nothing but true links leaves it. More points get more blocks, so cells get finer and
candidates grow little faster than the points.

Exact copies have one fingerprint and meet before the join, so a group of copies is one point however
large it is, and the links of a point are bounded by the points within three bits of it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torrentine.llm.common import id_text, materialize, sliced, texts
from torrentine.llm.components import components

EVEN = 0x5555555555555555


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text: A-Z lower-cased, repeats count, zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - width] if width > 1 else ends - lengths
        shingles = [joined[a:b] for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        counts += np.add.reduce(np.unpackbits(hashes[at : at + (1 << 16)], axis=1), axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for part in sliced(batches):
            found = np.array([fingerprint(t, width, seed) for t in texts(part, 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found)], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bits set in each two-bit segment, in unary (00, 01, 11), so that Manhattan distance is ``bit_count(a ^ b)``."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


#: Blocks of the grid for up to so many points at three bits: about 16, 20 and 22 coordinates of a cell must be equal.
BLOCKS = ((3e6, 6), (1e9, 8), (float("inf"), 10))


def cell_masks(blocks: int, bits: int) -> list[int]:
    """Masks of an embedding for each choice of ``blocks - bits`` blocks, as signed longs."""
    edges = [32 * i // blocks for i in range(blocks + 1)]
    parts = [sum(3 << 2 * j for j in range(a, b)) for a, b in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def links(distinct: DataFrame, bits: int = 3, blocks: int | None = None) -> DataFrame:
    """(u, v), u < v: pairs of different fingerprints of column ``fp`` that differ in at most ``bits`` bits; some come more than once.

    ``blocks`` is by default taken from the number of points (see ``BLOCKS``); it changes the cost, never the pairs.
    """
    if blocks is None:
        n = distinct.count()
        blocks = next(b for most, b in BLOCKS if n <= most) - 3 + bits
    e = embedding(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), e.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cell_masks(blocks, bits))])
    points = distinct.select("fp", F.explode(cells).alias("at")).select("fp", "at.i", "at.cell")
    left, right = points.select(F.col("fp").alias("u"), "i", "cell"), points.select(F.col("fp").alias("v"), "i", "cell")
    near = (F.col("u") < F.col("v")) & (F.bit_count(embedding(F.col("u")).bitwiseXOR(embedding(F.col("v")))) <= bits) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    return left.join(right, ["i", "cell"]).where(near).select("u", "v")


def simhash_groups(docs: DataFrame, width: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of ``bits`` bits or fewer).

    One row for each input row, repeated rows included. A null text has no words and fingerprint zero,
    which links like any other. A row with a null doc_id takes part; its component is the least
    identifier that is not null (null if there is none). An empty table gives no rows. Other columns
    are not read.
    """
    fps = materialize(fingerprints(docs, width, seed), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("lead")), "points")
    found = components(links(distinct.select("fp"), bits))
    member = distinct.join(found, distinct.fp == found.node, "left").select("fp", "lead", F.coalesce("component", "fp").alias("top"))
    least = member.groupBy("top").agg(F.min("lead").alias("component_id"))
    member = member.join(least, "top").select(F.col("fp").alias("point"), "component_id")
    return fps.join(member, fps.fp == member.point).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """The row of each near-duplicate group with the least doc_id; columns as they were, whatever their names.

    Of repeated rows with that identifier the first by text stays. Rows with a null doc_id can't stand
    for a group and pass unjudged. Null and empty texts are one group, whose fingerprint is zero; an empty table stays empty.
    """
    named = docs.where("doc_id is not null")
    groups = simhash_groups(named, width, bits, seed)
    leads = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("lead")).agg(F.count(F.lit(1)).alias("n_rows"))
    rows = named.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(leads.hint("shuffle_hash"), F.col("id") == F.col("lead"))  # whole texts are dealt out once and never sorted
    plain = [c for c, t in docs.dtypes if c not in ("doc_id", "text") and not t.startswith(("map", "variant"))]
    rank = F.row_number().over(Window.partitionBy("id").orderBy("row.text", *[f"row.`{c}`" for c in plain]))
    repeated = kept.where("n_rows > 1").withColumn("rank", rank).where("rank = 1")
    kept = kept.where("n_rows = 1").select("row").unionByName(repeated.select("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
