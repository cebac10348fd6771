"""Hash identities, canonical geometry tokens, dates and report helpers."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torrentine.functions.geo import coordinate_count, extent
from torrentine.functions.kernels import rowwise


def geometry_token(value) -> str:
    """A canonical form: sorted keys, numbers as the sixteen hex digits of the double, lists in order."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return struct.pack(">d", 0.0 if value == 0 else float(value)).hex()
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f'"{k}":{geometry_token(value[k])}' for k in sorted(value)) + "}"
    return "[" + ",".join(geometry_token(v) for v in value) + "]"


@rowwise(T.StringType())
def geometry_token_udf(kind, parts):
    return None if parts is None else geometry_token({"type": kind, "coordinates": [[[p["lon"], p["lat"]] for p in part] for part in parts]})


def geometry_hash(kind: Column, parts: Column) -> Column:
    return F.sha2(geometry_token_udf(kind, parts), 256)


def segment_id(*fields: Column) -> Column:
    """SHA-256 of fields joined by NUL; a null field is empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def geometry_summary(kind: Column, parts: Column) -> Column:
    return F.struct(geometry_hash(kind, parts).alias("sha256"), kind.alias("type"), extent(parts).alias("bbox"), coordinate_count(parts).alias("n"))


def hash_slug(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.left(F.md5(c), F.lit(10)))


def report_digest(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields])), 256)


def iso_date(day: Column, month: Column, year: Column) -> Column:
    """yyyy-MM-dd, or null if there is no such day."""
    return F.date_format(F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def is_stale(updated: Column, now: Column, days: int = 30) -> Column:
    """``days`` or more old; no date is stale."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp")) >= days * 86_400_000_000, F.lit(True))


def active_exception(status: Column, expires: Column, today: Column) -> Column:
    return F.coalesce((status == "approved") & (F.try_to_date(F.left(expires, F.lit(10))) >= today), F.lit(False))


def snapshot_date(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def shrink_to_fit(fields: list[tuple[str, Column]], budget: int) -> Column:
    """The fields as JSON, leaving out from the last on until it has at most ``budget`` bytes."""
    tries = [F.to_json(F.struct(*[c.alias(n) for n, c in fields[:k]])) for k in range(len(fields), 0, -1)]
    out = F
    for t in tries:
        out = out.when(F.octet_length(t) <= budget, t)
    return out.otherwise(F.lit("{}"))


def water_parts(kind: Column, line: Column, lines: Column, polygon: Column) -> Column:
    """Coordinates of a line, lines or polygon as one list of parts; anything else has none."""
    empty = F.array().cast(T.ArrayType(T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))))
    return F.when(kind == "LineString", F.array(line)).when(kind == "MultiLineString", lines).when(kind == "Polygon", polygon).otherwise(empty)
