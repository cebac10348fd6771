"""Stateful operators per key, in batch and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from torrentine.sources.scratch import dealt


def decide(accepted: list[float], now: float, window_s: float, most: int) -> tuple[list[float], bool, int]:
    """One hit against the accepted ones of its key: those still in the window, whether it passes, and seconds to wait.

    Refused hits are not remembered, so a key that keeps trying is let in when its oldest accepted hit leaves the window.
    """
    live = [t for t in accepted if t > now - window_s]
    if len(live) >= most:
        return live, False, max(1, int(-(-(live[0] + window_s - now) // 1)))
    return [*live, now], True, 0


def in_turn(rows: DataFrame, key: str, event: str, gap_s: float, step, kinds: str) -> DataFrame:
    """(key, event, ...) with what ``step(state, t, ok)`` returns after the new state, for the rows of a key in the order of t and event.

    The state is None at first and where a key has been still for ``gap_s``, after which it must mean nothing to ``step``. So a key is
    parted at its still times: slices of time without a row part it into runs, found from its distinct slices alone, and a hot key is as
    many runs as it has. A run is sorted by Spark and read in batches, so no history is held whole. Rows without a time see no state
    and leave none.
    """
    fields = StructType([StructField("k", rows.schema[key].dataType), StructField("e", rows.schema[event].dataType), *StructType.fromDDL(kinds).fields])
    rows = rows.select(F.col(key).alias("k"), F.col(event).alias("e"), "t", "ok", F.floor(F.col("t") / gap_s).alias("slice"))
    by_key = Window.partitionBy("k2").orderBy("slice2")
    runs = rows.select(F.col("k").alias("k2"), F.col("slice").alias("slice2")).distinct()
    runs = runs.withColumn("new", F.coalesce(F.col("slice2") - F.lag("slice2").over(by_key) > 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(runs, F.col("k").eqNullSafe(F.col("k2")) & F.col("slice").eqNullSafe(F.col("slice2"))).select("k", "e", "t", "ok", "run")
    names = [f.name for f in fields[2:]]
    types = [{"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()] for f in fields[2:]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for b in batches:
            out = []
            for k, run, t, ok in zip(*(b.column(i).to_pylist() for i in (0, 4, 2, 3))):
                if (k, run) != of:
                    of, state = (k, run), None
                if t is None:
                    out.append(step(None, float("nan"), ok)[1:])
                else:
                    state, *told = step(state, t, ok)
                    out.append(told)
            told = [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * len(names), types)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *told], names=["k", "e", *names])

    ordered = dealt(rows, "k", "run").sortWithinPartitions("k", "run", "t", F.asc_nulls_last("e"))
    return ordered.mapInArrow(work, fields).withColumnsRenamed({"k": key, "e": event})


def timed(events: DataFrame, key: str, ts: str, event: str, ok: Column) -> DataFrame:
    return events.select(key, event, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.coalesce(ok, F.lit(False)).alias("ok"))


def rate_limited(events: DataFrame, key: str, ts: str, event: str, window_s: float = 600.0, most: int = 5) -> DataFrame:
    """(key, event, allowed, retry_after) of each event, in the order of time and event; one without a time passes."""
    def step(live, t, _):
        return decide(live or [], t, window_s, most)

    return in_turn(timed(events, key, ts, event, F.lit(True)), key, event, window_s, step, "allowed boolean, retry_after int")


def rate_limited_stream(events: DataFrame, key: str, ts: str, event: str, window_s: float = 600.0, most: int = 5) -> DataFrame:
    """The same over a stream: the accepted times of a key are its state, which goes once the watermark is a window past the last."""
    kinds = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", event])
        out = []
        for t in rows["t"]:
            live, ok, wait = decide(live, t, window_s, most)
            out.append((ok, wait))
        state.update((live,))
        state.setTimeoutTimestamp(max(int((live[-1] + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows[key].values, event: rows[event].values, "allowed": [o for o, _ in out], "retry_after": [w for _, w in out]})

    rows = events.withWatermark(ts, f"{int(window_s)} seconds").select(key, event, ts, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    schema = f"`{key}` {kinds[key]}, `{event}` {kinds[event]}, allowed boolean, retry_after int"
    return rows.groupBy(key).applyInPandasWithState(run, schema, "live array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def ttl_deduped(events: DataFrame, key: str, ts: str, event: str, ok: Column, ttl_s: float = 60.0) -> DataFrame:
    """(key, event, outcome): run, or cached within ``ttl_s`` of the last success; a failure is not remembered."""
    def step(done, t, good):
        if done is not None and t - done < ttl_s:
            return done, "cached"
        return (t, "run") if good else (None, "failed")

    return in_turn(timed(events, key, ts, event, ok), key, event, ttl_s, step, "outcome string")


def deduped_stream(events: DataFrame, key: str, ts: str, ttl: str = "60 seconds") -> DataFrame:
    """The first event of a key within a watermark, for streams."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def keep_within_budget(entries: DataFrame, used: str, size: str, most_bytes: int, most: int, buckets: int = 256) -> DataFrame:
    """Entries from the last used on, while both limits hold; the rest is evicted. ``used`` must be a total order and numeric.

    The running sum is taken in range buckets and added up over their totals, so no task sorts all entries.
    """
    marks = entries.select(F.percentile_approx(used, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(10_000)).alias("m"))
    rows = entries.join(F.broadcast(marks)).withColumn("_b", F.aggregate("m", F.lit(0), lambda a, x: a + (x < F.col(used)).cast("int"))).drop("m")
    sums = rows.groupBy("_b").agg(F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_n"))
    later = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(later), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_n0"))
    w = Window.partitionBy("_b").orderBy(F.desc(used)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, "_b").withColumn("_sum", F.col("_s0") + F.sum(size).over(w)).withColumn("_k", F.col("_n0") + F.count(F.lit(1)).over(w))
    return rows.where((F.col("_sum") <= most_bytes) & (F.col("_k") <= most)).drop("_b", "_s0", "_n0", "_sum", "_k")


def latest_generation(rows: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """Rows of the latest generation of each key; late rows of older ones drop out."""
    now = rows.groupBy(*keys).agg(F.max(generation).alias("_g"))
    return rows.join(now, keys).where(F.col(generation) == F.col("_g")).drop("_g")


def report_pipeline(reports: DataFrame, key: str, ts: str, event: str) -> DataFrame:
    """(event, outcome) of reports (message, website, digest): invalid, bot, duplicate, limited or accepted, in this order."""
    valid = F.length(F.trim("message")).between(10, 2000)
    state = reports.withColumn("_state", F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.coalesce(F.col("website"), F.lit("")) != "", "bot"))
    seen = ttl_deduped(state.where("_state is null"), "digest", ts, event, F.lit(True)).where("outcome = 'run'").select(event)
    fresh = reports.join(seen, event, "left_semi")
    limited = rate_limited(fresh, key, ts, event).select(event, F.when(F.col("allowed"), "accepted").otherwise("limited").alias("_o"))
    return state.join(limited, event, "left").select(event, F.coalesce("_state", "_o", F.lit("duplicate")).alias("outcome"))
