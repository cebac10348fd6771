"""Sinks and merges: upserts, overlays, deterministic files, guarded and transactional writes."""

from __future__ import annotations

import gzip
import json
import os
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; what an upsert keeps, negative rows included."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with new rows in place of those of their keys."""
    return cache.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def touch(cache: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Cached rows with hit_count and last_accessed raised by the hits (key, at)."""
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    out = cache.join(n, key, "left")
    return out.withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "_at")).drop("_n", "_at")


def by_priority(tiers: dict[str, DataFrame], key: str, name: str) -> DataFrame:
    """One row a key from the first tier that has it, with the tier's name."""
    rows = None
    for i, (tier, d) in enumerate(tiers.items()):
        d = d.withColumn(name, F.lit(tier)).withColumn("_p", F.lit(i))
        rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_p")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def overlay(base: DataFrame, key: str, value: str, overlays: list[DataFrame]) -> DataFrame:
    """The value of the first overlay that has one, else of the base."""
    out, cols = base, []
    for i, o in enumerate(overlays):
        out = out.join(o.select(key, F.col(value).alias(f"_o{i}")), key, "left")
        cols.append(f"_o{i}")
    return out.withColumn(value, F.coalesce(*cols, value)).drop(*cols)


def preserve(new: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A rebuilt table with values of the previous one where its own are missing."""
    old = previous.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    out = new.join(old, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_old_{c}"))
    return out.drop(*[f"_old_{c}" for c in columns])


def split_column(rows: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows without a wide column, and (key, column) where it has a value."""
    return rows.drop(column), rows.where(F.col(column).isNotNull()).select(key, column)


def append_provenance(log: DataFrame, entry: DataFrame, path: str = "raw_file_path") -> DataFrame:
    """The log with the entry in place of one for the same file."""
    return upsert(log, entry, [path])


def feature_collection(rows: DataFrame, geometry_json: str, properties: list[str], hidden: str = "_hidden") -> DataFrame:
    """One GeoJSON feature a row, in a string; hidden ones drop out."""
    shown = rows.where(~F.coalesce(F.col(hidden), F.lit(False))) if hidden in rows.columns else rows
    props = F.to_json(F.struct(*properties))
    return shown.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry_json, F.lit("null")), F.lit("}")).alias("feature"))


def frontend(rows: DataFrame, names: dict[str, str], defaults: dict[str, object], order: str) -> DataFrame:
    """Renamed columns with defaults, in the order of the Romanian alphabet."""
    cols = [F.coalesce(F.col(a), F.lit(defaults[b])).alias(b) if b in defaults else F.col(a).alias(b) for a, b in names.items()]
    return rows.orderBy(F.collate(F.col(order), "ro")).select(*cols)


def contained(root: str, path: str) -> str:
    """``path`` under ``root``, or an error if it leads out of it."""
    full, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} is outside {root}")
    return full


def outside(root: str, path: str) -> str:
    """``path``, or an error if it lies within the published folder ``root``."""
    full, base = os.path.realpath(path), os.path.realpath(root)
    if full == base or full.startswith(base + os.sep):
        raise ValueError(f"{path} is inside the published folder {root}")
    return full


def guarded_write(rows: DataFrame, path: str, required: list[str] = ()) -> None:
    """Write Parquet to a new place; no rows, or a required column with nulls only, is an error."""
    checks = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in required]).first()
    if not checks["n"] or any(not checks[c] for c in required):
        raise ValueError(f"refusing to write {path}: {checks.asDict()}")
    rows.write.mode("errorifexists").parquet(path)


def write_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """All tables as one snapshot: a folder of its own, told apart by a marker that is written last."""
    place = f"{root}/v{version}-{uuid.uuid4().hex[:8]}"
    for name, d in tables.items():
        d.write.parquet(f"{place}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, ",".join(sorted(tables)))], "version int, names string").coalesce(1).write.parquet(f"{place}/_complete")
    return place


def write_jsonl(rows: DataFrame, path: str, order: list[str], compression: str = "gzip") -> None:
    """JSON lines in a total order, sorted keys, in as many files as the range sort makes."""
    cols = sorted(rows.columns)
    rows.select(*cols).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path, compression=compression)


def write_jsonl_gz(records: Iterable[dict], path: str) -> None:
    """A small deterministic gzip: sorted keys, compact, no time and no name in the header."""
    with open(path, "wb") as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as f:
        for r in records:
            f.write((json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode())


def write_extract(meta: DataFrame, body: DataFrame, path: str, order: list[str]) -> None:
    """One text table of JSON lines, the meta line first, then the body in order."""
    line = lambda d, rank: d.select(F.lit(rank).alias("rank"), *[F.col(o) if o in d.columns else F.lit(None).cast("string").alias(o) for o in order], F.to_json(F.struct(*sorted(d.columns))).alias("value"))
    rows = line(meta, 0).unionByName(line(body, 1))
    rows.repartitionByRange("rank", *order).sortWithinPartitions("rank", *order).select("value").write.mode("overwrite").text(path)


SECRET = re.compile(r"token|secret|password|key", re.I)
