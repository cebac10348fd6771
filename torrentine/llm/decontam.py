"""Benchmark decontamination by pigeonhole edit matching.

An item of the benchmark with an error budget of k is cut into k+1 pieces. A passage within k edits of it
holds one piece unchanged, so an Aho-Corasick automaton over all pieces finds every passage that can
match, in one pass over a whole text; Myers' bit-parallel distance then verifies the window around the hit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentine.llm.common import id_text, in_slices, sliced

#: Items held by a task at once: their characters, in blocks; each further block is one more pass over the texts.
BLOCK_CHARS = 2_000_000
#: Least characters of a piece, and the budget as a share of an item. At this share a piece has eight characters or
#: more for every length, so the first binds only for larger shares.
PIECE_CHARS, ERROR_RATE = 8, 0.06


def normal(text: str | None) -> str:
    """Lower case with each run of blanks as one space, so case and line breaks are no edits."""
    s = (text or "").lower()
    for c in "\n\t\r\x0b\x0c":
        s = s.replace(c, " ")
    return " ".join(filter(None, s.split(" "))) if "  " in s else s.strip(" ")


def budget(length: int, error_rate: float = ERROR_RATE, piece_chars: int = PIECE_CHARS) -> int:
    return max(0, min(int(length * error_rate), length // piece_chars - 1))


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces of nearly the same length, as (place, piece)."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern anywhere in text, if within k edits; the first of equals."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, (m, 0) if m <= k else None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(zero | up) & full, up & zero
        if score <= k and (best is None or score < best[0]):
            best = score, j + 1
    return best


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a passage starts and ends where words do."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def find_alone(text: str, pattern: str) -> int:
    """First place of a pattern as words of its own, or -1."""
    at = text.find(pattern)
    while at >= 0 and not stands_alone(text, at, at + len(pattern)):
        at = text.find(pattern, at + 1)
    return at


class Matcher:
    """Items of one block and the automaton over their pieces. An item too short for an edit must stand as words of its own."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, piece_chars: int):
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, text in items:
            if text:
                k = budget(len(text), error_rate, piece_chars)
                self.items.append((item_id, text, k))
                for at, piece in cut(text, k):
                    pieces.setdefault(piece, []).append((len(self.items) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, place, end) of the best match of each item that the normal text holds."""
        hits: dict[int, set[int]] = {}
        if len(self.automaton):
            for end, (n, where) in self.automaton.iter(text):
                for item, at in where:
                    hits.setdefault(item, set()).add(end + 1 - n - at)
        found = []
        for item, starts in sorted(hits.items()):
            item_id, pattern, k = self.items[item]
            at = text.find(pattern) if k else find_alone(text, pattern)
            if at >= 0:
                found.append((item_id, 0, at, at + len(pattern)))
            if at >= 0 or not k:
                continue
            best, done = None, -1
            for start in sorted(starts):
                low, high = max(start - k, 0), start + len(pattern) + k
                if high <= done:
                    continue
                done = high
                got = myers(pattern, text[low:high], k)
                if got and (best is None or got[0] < best[0]):
                    best = got[0], low, low + got[1]
            if best:
                found.append((item_id, *best))
        return found


_built: dict[int, Matcher] = {}


def _matcher(key: int, items, error_rate: float, piece_chars: int) -> Matcher:
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, error_rate, piece_chars)
    return _built[key]


def _blocks(benchmark: DataFrame):
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        text = normal(row[1])
        if block and held + len(text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row[0], text))
        held += len(text)
    if block:
        yield block


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
FOUND_DDL = "doc_id long, item_id long, n_edits int, `start` long, `end` long"


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, item_id, n_edits, start, end: the best match of each item in each row of docs that holds it.

    An item may differ in ``error_rate`` of its characters; one that is too short for a single edit must be there
    exactly, as words of its own, so "a" is not found in "day". Texts are compared in lower case with runs of blanks
    as one space; start and end count characters of that form; an inexact match starts at the earliest place where it can. Items pass through the driver in blocks of
    ``BLOCK_CHARS`` characters, each of which is matched with all texts. Null or blank texts and items match nothing; a null doc_id or
    item_id is carried; repeated rows match each for itself; an empty table gives no rows. Other columns are not read.
    """
    rows, found = id_text(docs), None
    for block in _blocks(benchmark):
        key = hash((tuple(block), error_rate, piece_chars))

        def run(batches, key=key, block=block):
            matcher = _matcher(key, block, error_rate, piece_chars)

            def one():
                for batch in sliced(batches):
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        for match in matcher.find(normal(text)) if text else ():
                            yield (doc_id, *match)

            yield from in_slices(one(), FOUND)

        part = rows.mapInArrow(run, FOUND_DDL)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], FOUND_DDL) if found is None else found


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", error_rate: float = ERROR_RATE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds an item (see :func:`contaminated`); columns as they were, whatever their names.

    Rows with null or empty texts stay, as do rows with null identifiers that hold no item; repeated rows share one verdict. Without
    items, or with none but null and blank ones, every row stays; an empty table stays empty.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    for block in _blocks(benchmark):
        key = hash((tuple(block), error_rate, piece_chars))

        def run(batches, key=key, block=block):
            matcher = _matcher(key, block, error_rate, piece_chars)
            for batch in sliced(batches):
                keep = pa.array([not (t and matcher.find(normal(t))) for t in batch.column(at).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(keep)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
