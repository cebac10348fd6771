"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

Documents are dealt into groups by a hash. A group hashes all its windows, keeps each hash once (with
a mark if it came twice) and sends the sorted hashes, cut by their leading bits, to buckets. A bucket
holds every group's hashes of its range, so it sees which came from two groups or bear a mark, and
returns one bit for each hash it was sent. The group, read again, knows its sorted hashes and so what
each bit means. What one hash marks is confirmed by a second, independent one in the same way: only windows
that agree in both, 128 bits, are equal. Repeated windows that touch merge into maximal intervals, whose words go.

A hash that a third of all windows share costs one entry a group; nothing holds more than one group or
one bucket, and both are sized in bytes, so their number grows with the corpus and their size does not.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentine.llm.common import id_text, materialize, texts

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text in a group, about; and rows of one identifier from which on they are dealt by place, as they may be one text.
GROUP_BYTES, MANY_ROWS = 8 << 20, 1000


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64 and then mixed, of each run of ``width`` word hashes, by doubling."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    run, run_len, done, done_len, left = words, 1, None, 0, width
    while left:
        if left & 1:
            part = run[done_len : done_len + n]
            done = part if done is None else done * BASE ** np.uint64(run_len) + part
            done_len += run_len
        left >>= 1
        if left:
            run = run[:-run_len] * BASE ** np.uint64(run_len) + run[run_len:]
            run_len *= 2
    done = (done ^ done >> np.uint64(32)) * MIX
    return done ^ done >> np.uint64(29)


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Places at which a new key starts in sorted keys."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Group:
    """Words of a group of documents and the hashes of their windows; ``first_bits`` leading bits of the first hash count."""

    def __init__(self, table: pa.Table, column: str, width: int, first_bits: int = 64):
        digest, parts, self.lengths = xxhash.xxh3_128_digest, [], []
        for batch in table.select([column]).to_batches():
            for text in texts(batch, 0):
                words = (text or b"").split()
                parts.append(b"".join([digest(w) for w in words]))
                self.lengths.append(len(words))
        self.words = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
        self.ends = np.cumsum(self.lengths, dtype=np.int64)
        self.width, self.n_words = width, len(self.words)
        hashes = window_hashes(self.words[:, 0], width)
        if len(hashes):  # windows that cross into the next document are none
            end = np.repeat(self.ends, self.lengths)[: len(hashes)]
            self.starts = np.flatnonzero(np.arange(len(hashes)) + width <= end)
            self.hashes = hashes[self.starts] >> np.uint64(64 - first_bits) << np.uint64(64 - first_bits)
        else:
            self.starts, self.hashes = np.zeros(0, np.int64), hashes

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes, each once, and which of them came twice or more."""
        ordered = np.sort(self.hashes)
        at = _firsts(ordered)
        return ordered[at], np.diff(np.append(at, len(ordered))) > 1

    def pairs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose hash is marked (sorted): both hashes, each pair once and sorted, which came twice, the windows, and the pair of each."""
        none = np.zeros(0, np.int64)
        if not len(marked):
            return none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none, none
        i = np.minimum(np.searchsorted(marked, self.hashes), len(marked) - 1)
        at = np.flatnonzero(marked[i] == self.hashes)
        first, second = self.hashes[at], window_hashes(self.words[:, 1], self.width)[self.starts[at]]
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = _firsts(first, second)
        n = np.diff(np.append(new, len(first)))
        return first[new], second[new], n > 1, at[order], np.repeat(np.arange(len(new)), n)

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Words in one of the windows."""
        step = np.zeros(self.n_words + 1, np.int64)
        hit = self.starts[windows]
        step[hit] += 1
        np.subtract.at(step, hit + self.width, 1)
        return np.cumsum(step[:-1]) > 0


def _cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _shrink(hashes: np.ndarray) -> bytes:
    """Sorted hashes as their first and the steps between them, in six bytes each where they fit."""
    step = np.diff(hashes)
    if len(step) and int(step.max()) >= 1 << 48:
        return b"\x08" + hashes.tobytes()
    return b"\x06" + hashes[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _grow(data: bytes) -> np.ndarray:
    if data[0] == 8:
        return np.frombuffer(data, np.uint64, offset=1)
    step = np.zeros(((len(data) - 9) // 6 + 1, 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8, 1)
    step[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _repeated(keys: tuple[np.ndarray, ...], twice: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For each sender's keys, given one after the other, which came twice or came from another sender too."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    same = np.zeros(len(order) + 1, bool)
    if len(order):
        same[1:-1] = True
    for k in keys:
        same[1:-1] &= k[order][1:] == k[order][:-1]
    twice[order] |= same[1:] | same[:-1]
    return np.split(twice, np.cumsum(sizes)[:-1])


def _table(columns: list[list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _marked(hashes: np.ndarray, cut: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The hashes that buckets have marked, sorted."""
    found = [hashes[cut[b] : cut[b + 1]][_bits(answers[b], cut[b + 1] - cut[b])] for b in sorted(answers)]
    return np.concatenate(found) if found else hashes[:0]


def _dealt(rows: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` with their group g, by a hash of identifier and text, and of the place too where an identifier has many rows."""
    many = rows.groupBy("doc_id").count().where(F.col("count") >= MANY_ROWS).select(F.col("doc_id").alias("hot"))
    place = F.lit(0).cast("long")
    if many.where("hot is null").take(1):
        place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(place)
    if many.where("hot is not null").take(1):
        hot = materialize(many.where("hot is not null"), "hot")
        rows = rows.join(hot, F.col("doc_id") == F.col("hot"), "left")
        place = F.when(F.col("hot").isNotNull(), F.monotonically_increasing_id()).otherwise(place)
    return rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", place), F.lit(n_groups)).alias("g"))


def drop_repeats(docs: DataFrame, width: int = 35, with_text: bool = False, group_bytes: int = GROUP_BYTES, first_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with_text adds kept_text and removed, the maximal intervals [start, end) of words that went.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window of ``width`` words goes, all its words, if
    its word sequence also starts anywhere else, in the same document or another; windows are judged on the
    input. Every row of the input gives one, so of repeated rows of ``width`` words or more nothing stays. Null and empty texts have no
    words; a null doc_id is kept. An empty table gives no rows; other columns are not read. ``first_bits`` shortens the first hash,
    for tests: it costs more confirmations and changes no result.

    ``docs`` is read more than once: where an identifier has ``MANY_ROWS`` rows it must be a table, or else be materialized first.
    """
    rows = id_text(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_groups = max(1, -(-total // group_bytes))
    bits = max(0, (n_groups - 1).bit_length())
    rows = _dealt(rows, n_groups)
    full = lambda cut: [b for b in range(1 << bits) if cut[b] < cut[b + 1]]

    sent = pa.schema([("g", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary())])

    def send(key, table):
        hashes, twice = Group(table, "text", width, first_bits).distinct()
        cut = _cuts(hashes, bits)
        parts = [(b, slice(cut[b], cut[b + 1])) for b in full(cut)]
        return _table([[key[0].as_py()] * len(parts), [b for b, _ in parts], [p.stop - p.start for _, p in parts], [_shrink(hashes[p]) for _, p in parts], [np.packbits(twice[p]).tobytes() for _, p in parts]], sent)

    answer = pa.schema([("g", pa.int64()), ("bucket", pa.int64()), ("marks", pa.binary())])

    def judge(key, table):
        sizes, groups = table.column("n").to_pylist(), table.column("g").to_pylist()
        hashes = np.concatenate([_grow(x) for x in table.column("hashes").to_pylist()])
        twice = np.concatenate([_bits(x, n) for x, n in zip(table.column("twice").to_pylist(), sizes)])
        parts = [(g, x) for g, x in zip(groups, _repeated((hashes,), twice, sizes)) if x.any()]
        return _table([[g for g, _ in parts], [key[0].as_py()] * len(parts), [np.packbits(x).tobytes() for _, x in parts]], answer)

    again = pa.schema([*sent, ("seconds", pa.binary()), ("marks", pa.binary())])

    def ask(key, table, answers):
        """The pairs of hashes of the marked windows, to the buckets that marked them."""
        if not table.num_rows or not answers.num_rows:
            return again.empty_table()
        group = Group(table, "text", width, first_bits)
        hashes, _ = group.distinct()
        marks = dict(zip(answers.column("bucket").to_pylist(), answers.column("marks").to_pylist()))
        first, second, twice, _, _ = group.pairs(_marked(hashes, _cuts(hashes, bits), marks))
        cut = _cuts(first, bits)
        parts = [(b, slice(cut[b], cut[b + 1])) for b in full(cut)]
        cols = [[key[0].as_py()] * len(parts), [b for b, _ in parts], [p.stop - p.start for _, p in parts], [_shrink(first[p]) for _, p in parts], [np.packbits(twice[p]).tobytes() for _, p in parts]]
        return _table([*cols, [second[p].tobytes() for _, p in parts], [marks[b] for b, _ in parts]], again)

    final = pa.schema([*answer, ("equal", pa.binary())])

    def confirm(key, table):
        sizes = table.column("n").to_pylist()
        first = np.concatenate([_grow(x) for x in table.column("hashes").to_pylist()])
        second = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("seconds").to_pylist()])
        twice = np.concatenate([_bits(x, n) for x, n in zip(table.column("twice").to_pylist(), sizes)])
        equal = [np.packbits(x).tobytes() for x in _repeated((first, second), twice, sizes)]
        return _table([table.column("g").to_pylist(), [key[0].as_py()] * len(sizes), table.column("marks").to_pylist(), equal], final)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        fields += [("kept_text", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))]
    out = pa.schema(fields)

    def cut_out(key, table, answers):
        if not table.num_rows:
            return out.empty_table()
        group = Group(table, "text", width, first_bits)
        hashes, _ = group.distinct()
        buckets = answers.column("bucket").to_pylist()
        first, _, _, windows, pair = group.pairs(_marked(hashes, _cuts(hashes, bits), dict(zip(buckets, answers.column("marks").to_pylist()))))
        cut, equal = _cuts(first, bits), np.zeros(len(first), bool)
        for b, data in zip(buckets, answers.column("equal").to_pylist()):
            equal[cut[b] : cut[b + 1]] = _bits(data, cut[b + 1] - cut[b])
        gone = group.covered(windows[equal[pair]])
        cols: list[list] = [[] for _ in fields]
        cols[0], at = table.column("doc_id").to_pylist(), 0
        for batch in table.select(["text"]).to_batches():
            for text in texts(batch, 0):
                words = (text or b"").split()
                mine = gone[at : at + len(words)]
                at += len(words)
                n = int(mine.sum())
                kept = b" ".join(compress(words, (~mine).tolist()) if n else words)
                row = [len(words), n, hashlib.sha256(kept).hexdigest()]
                if with_text:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                    row += [kept.decode(), edge.reshape(-1, 2).tolist()]
                for c, x in zip(cols[1:], row):
                    c.append(x)
        return _table(cols, out)

    mine = rows.groupBy("g")
    hashed = mine.applyInArrow(send, "g long, bucket long, n long, hashes binary, twice binary")
    judged = hashed.groupBy("bucket").applyInArrow(judge, "g long, bucket long, marks binary")
    asked = mine.cogroup(judged.groupBy("g")).applyInArrow(ask, "g long, bucket long, n long, hashes binary, twice binary, seconds binary, marks binary")
    confirmed = asked.groupBy("bucket").applyInArrow(confirm, "g long, bucket long, marks binary, equal binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<array<long>>" * with_text
    return mine.cogroup(confirmed.groupBy("g")).applyInArrow(cut_out, schema)
