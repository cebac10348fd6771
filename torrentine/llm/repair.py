"""Repair of conversation structure by a lazily determinised weighted automaton.

The grammar of a conversation, an optional system turn and then pairs of user and assistant, is an automaton of four states
whose arcs cost what an edit costs. Reading rows, the least costs of the four states form a vector; taken relative to
its least entry, such a vector is one state of a deterministic automaton. Its states and transitions are made when they are first
met and kept in a table, so a row is one lookup; the weights on the way sum to the cost. Each transition also keeps
its tight arcs, those that a cheapest path may use. Followed backward from the end they leave exactly the cheapest paths, of
which the audit takes the one that is least as text.

Rows are sorted by range, so that a conversation of any size spreads over tasks. One that lies within a task is done there. Of one
that goes on in the next task, each task sums its part up as sixteen numbers (least cost between any two states); those
of all parts give each part the vector it starts with and the states it may end in, and the parts are traced independently.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentine.llm.common import in_slices, materialize

INF = 1 << 40
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: nothing yet, a system turn, a user's, an assistant's; a conversation may end in the first or the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FINAL = (START, AFTER_A)
#: Where the initial of a kept row leads, and the role that a row can be given or that can be put in; one in each state.
KEEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
GIVES = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)

WS = " \t\n\x0b\x0c\r"
STOPS = ".!?"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows as the contract damages them, ``n`` times each; null fields are one space.

    A dropped row stays with n = 0 and nothing else, so that its conversation is not forgotten.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dice = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(dice == 1, "").when(dice == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(dice == 4, "user").otherwise(space("role"))
    left = lambda c: F.when(dice != 0, c)
    n = F.when(dice == 0, 0).when(dice == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", left(F.col("turn").cast("long")).alias("turn"), left(role).alias("role"), left(text).alias("text"), n.alias("n"))


def own_fault(text: str) -> int:
    """BLANK or CUT as the text alone tells, else SOUND."""
    kept = text.rstrip(WS)
    return BLANK if not kept else SOUND if kept[-1] in STOPS else CUT


def closed(v: list[int]) -> tuple[int, ...]:
    """Least costs when turns may be put in; costs that no cheapest path starts from become INF.

    Where an assistant's turn has just ended, anything can follow that can follow a system turn, and, if one more row is
    deleted, anything that can follow nothing; so these two need not be known beyond that.
    """
    for _ in range(3):
        for q, to in GIVES.items():
            v[to] = min(v[to], v[q] + INSERT)
    if v[START] > v[AFTER_A] + DELETE:
        v[START] = INF
    if v[AFTER_S] > v[AFTER_A]:
        v[AFTER_S] = INF
    return tuple(min(x, INF) for x in v)


class Automaton:
    """The deterministic automaton, as far as it has been needed.

    ``vectors`` are its states' cost vectors, least entry zero; ``table`` has (next state, weight, tight arcs) by state and symbol,
    where a tight arc is (letter, from, to). A symbol is the initial ('' for any that no turn may have) and the fault.
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str, int], tuple[int, int, tuple]] = {}
        self.before: dict[tuple[int, str, int, int], int] = {}

    def state(self, v) -> tuple[int, int]:
        """Number of the state of a closed vector, and the least entry taken off."""
        least = min(v)
        key = tuple(x - least if x < INF else INF for x in v)
        if key not in self.known:
            self.known[key] = len(self.vectors)
            self.vectors.append(key)
        return self.known[key], least

    def step(self, d: int, initial: str, fault: int) -> tuple[int, int, tuple]:
        got = self.table.get((d, initial, fault))
        if got is None:
            v = self.vectors[d]
            arcs = [("D", q, q, DELETE) for q in range(4)]
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                arcs += [("K", q, to, more) for q, to in KEEPS.get(initial, {}).items()]
                arcs += [("R", q, to, REROLE + more) for q, to in GIVES.items()]
            out = [INF] * 4
            for _, q, to, c in arcs:
                out[to] = min(out[to], v[q] + c)
            after = closed(out)
            nxt, weight = self.state(after)
            got = nxt, weight, tuple((k, q, to) for k, q, to, c in arcs if v[q] < INF and after[to] < INF and v[q] + c == after[to])
            self.table[d, initial, fault] = got
        return got

    def tight_inserts(self, d: int) -> list[tuple[int, int]]:
        v = self.vectors[d]
        return [(q, to) for q, to in GIVES.items() if v[q] < INF and v[q] + INSERT == v[to]]

    def widened(self, d: int, mask: int) -> int:
        """The states from which tight insertions lead into ``mask``, itself included."""
        for _ in range(3):
            for q, to in self.tight_inserts(d):
                if mask >> to & 1:
                    mask |= 1 << q
        return mask

    def back(self, d: int, initial: str, fault: int, mask: int) -> int:
        """The states before a row from which tight arcs lead into ``mask`` after it."""
        key = d, initial, fault, mask
        if key not in self.before:
            m = 0
            for _, q, to in self.step(d, initial, fault)[2]:
                if mask >> to & 1:
                    m |= 1 << q
            self.before[key] = self.widened(d, m)
        return self.before[key]

    def scan(self, d: int, symbols: list[tuple[str, int, int]]) -> tuple[list[int], int]:
        """The states before each symbol and after the last, and the weights' sum.

        A symbol that comes several times must be deleted, which adds to all costs alike, so the state stays.
        """
        states, total, step = [d], 0, self.step
        for initial, fault, times in symbols:
            d, w, _ = step(d, initial, fault)
            states.append(d)
            total += w * times
        return states, total

    def marks(self, states: list[int], symbols: list[tuple[str, int, int]], mask: int) -> list[int]:
        """For each place, the states that cheapest paths into ``mask`` pass."""
        found = [self.widened(states[-1], mask)]
        for d, (initial, fault, _) in zip(reversed(states[:-1]), reversed(symbols)):
            found.append(self.back(d, initial, fault, found[-1]))
        return found[::-1]

    def trace(self, states, symbols, marks, q: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
        """(letter, state entered, symbol) of the least audit from ``q`` along marked tight arcs, and where it ends.

        A final state that is marked at the end is where a cheapest path stops, as to go on costs more.
        """
        taken, i, n = [], 0, len(symbols)
        while i < n or last and q not in FINAL:
            moves = [("I", to, 0) for f, to in self.tight_inserts(states[i]) if f == q and marks[i] >> to & 1]
            if i < n:
                moves += [(k, to, 1) for k, f, to in self.step(states[i], *symbols[i][:2])[2] if f == q and marks[i + 1] >> to & 1]
            k, q, on = min(moves)
            taken.append((k, q, i))
            i += on
        return taken, q

    def final(self, d: int) -> tuple[int, int]:
        """Cost of ending, and the mask of final states that cost it."""
        v = self.vectors[d]
        least = min(v[f] for f in FINAL)
        return least, sum(1 << f for f in FINAL if v[f] == least)


class Part:
    """Rows of one conversation that lie in one task, in order, and what is counted over them."""

    def __init__(self, auto: Automaton, rows: list[tuple[int | None, str, str, int, bool | None]]):
        """rows: turn, role, text, copies, and whether the role and text stood at an earlier turn (None: look among these rows).

        ``symbols`` are (initial, fault, times); the copies after a row's first are one symbol, as all of them must be deleted.
        """
        self.auto, self.rows, self.symbols = auto, [], []
        seen: set[tuple[str, bytes]] = set()
        self.counts = Counter()
        self.illegal = 0
        self.first_initial = self.last_initial = None
        rows = [r for r in rows if r[3]]
        turns = {r[0] for r in rows if r[0] is not None}
        self.turns, self.least, self.most = len(turns), min(turns, default=None), max(turns, default=None)
        for _, role, text, copies, stood in rows:
            fault, key = own_fault(text), (role, hashlib.sha256(text.encode()).digest())
            initial = role[:1] if role[:1] in KEEPS else ""
            kind = fault if fault == BLANK else DUPLICATE if (key in seen if stood is None else stood) else fault
            seen.add(key)
            if self.last_initial is None:
                self.first_initial = role[:1]
            else:
                self.illegal += not follows(self.last_initial, role[:1])
            self.last_initial = role[:1]
            self.illegal += copies - 1
            for kind, times in ((kind, 1), (BLANK if kind == BLANK else DUPLICATE, copies - 1)):
                if times:
                    self.counts[kind] += times
                    self.rows.append((role, text))
                    self.symbols.append((initial, kind, times))

    def faults(self) -> tuple[int, int, int]:
        return self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT]

    def matrix(self) -> list[int]:
        """Least cost from each state before these rows to each state after them."""
        out = []
        for q in range(4):
            d, least = self.auto.state(closed([0 if k == q else INF for k in range(4)]))
            states, total = self.auto.scan(d, self.symbols)
            out += [x + least + total if x < INF else INF for x in self.auto.vectors[states[-1]]]
        return out

    def said(self, taken: list[tuple[str, int, int]]) -> tuple[str, list[str]]:
        """Letters and the ``role:text`` of the turns that are left or put in."""
        letters, turns = [], []
        for k, q, i in taken:
            letters.append(k if k == "I" else k * self.symbols[i][2])
            if k == "I":
                turns.append(f"{ROLE[q]}:")
            elif k != "D":
                role, text = self.rows[i]
                turns.append(f"{ROLE[q] if k == 'R' else role}:{text}")
        return "".join(letters), turns

    def whole(self) -> tuple[int, str, str]:
        """Cost, audit and digest of a conversation that lies here whole."""
        auto = self.auto
        d, _ = auto.state(closed([0, INF, INF, INF]))
        states, total = auto.scan(d, self.symbols)
        least, mask = auto.final(states[-1])
        taken, _ = auto.trace(states, self.symbols, auto.marks(states, self.symbols, mask), START, True)
        audit, turns = self.said(taken)
        return total + least, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()

    def traces(self, vector: tuple[int, ...], mask: int, last: bool) -> Iterator[tuple[int, int, str, list[str]]]:
        """From each state that a cheapest path can enter by: that state, where it leaves, its audit and turns."""
        auto = self.auto
        d, _ = auto.state(vector)
        states, _ = auto.scan(d, self.symbols)
        marks = auto.marks(states, self.symbols, mask)
        for q in range(4):
            if marks[0] >> q & 1:
                taken, leave = auto.trace(states, self.symbols, marks, q, last)
                yield q, leave, *self.said(taken)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
LONG, TEXT = pa.int64(), pa.string()
DONE = pa.schema([("key", LONG), *((c, TEXT if c in ("audit", "repaired_sha256") else LONG) for c in NAMES)])
OPEN = pa.schema([("part", pa.int32()), ("turn", LONG), ("role", TEXT), ("text", TEXT), ("n", LONG)])
SUMMARY = pa.schema(
    [("key", LONG), ("part", pa.int32()), *((c, LONG) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most"))]
    + [("first_initial", TEXT), ("last_initial", TEXT), ("matrix", pa.list_(LONG))]
)
TRACE = pa.schema([("key", LONG), ("part", pa.int32()), ("enter", pa.int32()), ("leave", pa.int32()), ("audit", TEXT), ("turns", pa.list_(TEXT))])


def ddl(schema: pa.Schema) -> str:
    kinds = {LONG: "long", TEXT: "string", pa.int32(): "int", pa.list_(LONG): "array<long>", pa.list_(TEXT): "array<string>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def runs(batches, by: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows of equal ``by``, held for one such run at a time."""
    key, rows = None, []
    for batch in batches:
        for *k, row in zip(*(batch.column(c).to_pylist() for c in by), zip(*(batch.column(c).to_pylist() for c in columns))):
            if rows and tuple(k) != key:
                yield key, rows
                rows = []
            key = tuple(k)
            rows.append(row)
    if rows:
        yield key, rows


def gaps(least, most, turns) -> int:
    return 0 if least is None else most - least + 1 - turns


def follows(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


LINKED = "key long, part int, vector array<long>, mask int, last boolean, " + ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))


def linked(parts: pd.DataFrame) -> pd.DataFrame:
    """Where each part of one conversation starts and may end; the last one also has the counts. A row for each task that it lies in."""
    parts = parts.sort_values("part")
    steps = [[[int(x) for x in m[4 * r : 4 * r + 4]] for r in range(4)] for m in parts["matrix"]]
    ahead = [closed([0, INF, INF, INF])]
    for m in steps:
        ahead.append(closed([min(min(ahead[-1][r] + m[r][q], INF) for r in range(4)) for q in range(4)]))
    cost = min(ahead[-1][f] for f in FINAL)
    rest = [0 if q in FINAL else INF for q in range(4)]
    masks = [sum(1 << f for f in FINAL if ahead[-1][f] == cost)]
    for m, v in zip(reversed(steps[1:]), reversed(ahead[1:-1])):
        rest = [min(min(m[r][q] + rest[q], INF) for q in range(4)) for r in range(4)]
        masks.append(sum(1 << q for q in range(4) if v[q] < INF and v[q] + rest[q] == cost))
    total = {c: int(parts[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    spans = [(int(a), int(b)) for a, b in zip(parts["least"], parts["most"]) if not pd.isna(a)]
    total["turns"] -= sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # a turn that two parts share
    ends = [(a, b) for a, b in zip(parts["first_initial"], parts["last_initial"]) if a is not None]
    total["illegal"] += sum(not follows(a[1], b[0]) for a, b in zip(ends, ends[1:]))
    return pd.DataFrame(
        {
            "key": parts["key"],
            "part": parts["part"],
            "vector": [list(v) for v in ahead[:-1]],
            "mask": masks[::-1],
            "last": [False] * (len(parts) - 1) + [True],
            "gaps": gaps(min((a for a, _ in spans), default=None), max((b for _, b in spans), default=None), total.pop("turns")),
            "cost": cost,
            **total,
        }
    )


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for rows of conv_id, turn, role, text and n.

    One row for each conv_id of the input, null being one of them. Equal rows are repeats of each other; rows of one turn go by role and text, a
    null turn comes first. A role that is empty or has another initial than s, u or a can only be given another role or go. An empty table gives no rows.
    """
    spark = rows.sparkSession
    keyed = rows.select(F.col("conv_id"), "turn", "role", "text", "n")
    same = keyed.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    coarse = [*order[:3], F.asc_nulls_first(F.substring("text", 1, 64))]  # the borders of the ranges come to the driver
    ranged = materialize(same, "turns").repartitionByRange(tasks, *coarse).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["conv_id"]
    id_type = pa.schema([("conv_id", ranged.limit(0).toArrow().schema.field("conv_id").type)])
    schema = pa.schema([*id_type, *list(DONE)[1:], *OPEN])

    def within(batches):
        auto, part = Automaton(), TaskContext.get().partitionId()
        blank_done, blank_open = (None,) * len(NAMES), (None,) * len(OPEN)

        def out():
            held, first = None, True
            for (conv,), turns in runs(batches, ("conv_id",), ("turn", "role", "text", "n")):
                if held is not None:  # neither the first of the task nor, now, its last
                    p = Part(auto, [(*r, None) for r in held[1]])
                    yield (held[0], gaps(p.least, p.most, p.turns), *p.faults(), p.illegal, *p.whole(), *blank_open)
                    held = None
                if first:
                    yield from ((conv, *blank_done, part, *r) for r in turns)
                    first = False
                else:
                    held = conv, turns
            if held is not None:
                yield from ((held[0], *blank_done, part, *r) for r in held[1])

        yield from in_slices(out(), schema, 1024)

    both = materialize(ranged.mapInArrow(within, f"conv_id {kind}, {RESULT}, {ddl(OPEN)}"), "repairs")
    done = both.where("part is null").select("conv_id", *NAMES)
    return done.unionByName(across(both.where("part is not null").select("conv_id", *OPEN.names)).select("conv_id", *NAMES))


def across(rows: DataFrame) -> DataFrame:
    """The result for conversations that may lie in several parts: rows of conv_id, part, turn, role, text, n."""
    ids = rows.select("conv_id").distinct()  # two a task at most
    ids = materialize(ids.withColumn("key", F.monotonically_increasing_id()), "repair-keys")
    rows = rows.withColumnRenamed("conv_id", "_id").join(ids, F.col("_id").eqNullSafe(F.col("conv_id"))).drop("_id", "conv_id")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumn("digest", digest).withColumn("at", turn)
    first = rows.groupBy("key", "role", "digest").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least <> most").drop("most")
    rows = rows.join(first, ["key", "role", "digest"], "left").withColumn("stood", F.coalesce(F.col("at") > F.col("least"), F.lit(False)))
    rows = materialize(rows.select("key", "part", "turn", "role", "text", "n", "stood"), "repair-rows")
    order = ["key", "part", F.asc_nulls_first("turn"), "role", "text"]
    parts = rows.repartition("key", "part").sortWithinPartitions(*order)

    def summed(batches):
        auto = Automaton()

        def out():
            for (key, part), turns in runs(batches, ("key", "part"), ("turn", "role", "text", "n", "stood")):
                p = Part(auto, turns)
                yield (key, part, *p.faults(), p.illegal, p.turns, p.least, p.most, p.first_initial, p.last_initial, p.matrix())

        yield from in_slices(out(), SUMMARY)

    summaries = materialize(parts.mapInArrow(summed, ddl(SUMMARY)), "repair-parts")
    links = materialize(summaries.groupBy("key").applyInPandas(linked, LINKED), "repair-links")
    routes = links.select("key", "part", "vector", "mask", "last")

    def traced(batches):
        auto = Automaton()

        def out():
            for (key, part), turns in runs(batches, ("key", "part"), ("turn", "role", "text", "n", "stood", "vector", "mask", "last")):
                p, (vector, mask, last) = Part(auto, [t[:5] for t in turns]), turns[0][5:]
                for enter, leave, audit, said in p.traces(tuple(vector), mask, last):
                    yield key, part, enter, leave, audit, said

        yield from in_slices(out(), TRACE, 1)

    # the few routes are joined to the rows before they are sorted
    routed = rows.join(routes, ["key", "part"]).repartition("key", "part").sortWithinPartitions(*order)
    traces = routed.mapInArrow(traced, ddl(TRACE))

    def told(batches):
        """Follows a conversation through its parts, one part in memory at a time."""

        def out():
            at, done, state, audit, sha, any_turn = None, None, START, [], None, False
            for batch in batches:
                for key, part, enter, leave, letters, said in zip(*(batch.column(c).to_pylist() for c in TRACE.names)):
                    if key != at:
                        if at is not None:
                            yield at, "".join(audit), sha.hexdigest()
                        at, done, state, audit, sha, any_turn = key, None, START, [], hashlib.sha256(), False
                    if enter != state or part == done:
                        continue
                    done = part
                    audit.append(letters)
                    for turn in said:
                        sha.update((b"\n" if any_turn else b"") + turn.encode())
                        any_turn = True
                    state = leave
            if at is not None:
                yield at, "".join(audit), sha.hexdigest()

        yield from in_slices(out(), pa.schema([("key", LONG), ("audit", TEXT), ("repaired_sha256", TEXT)]), 1)

    texts = traces.repartition("key").sortWithinPartitions("key", "part", "enter").mapInArrow(told, "key long, audit string, repaired_sha256 string")
    counts = links.where("last").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(counts, "key").join(texts, "key").select("conv_id", *NAMES)
