"""Geometry scalars as Column expressions. A geometry is ``array<array<struct<lon,lat>>>``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
GEOMETRY = "array<array<struct<lon:double,lat:double>>>"
POINT = "struct<lon:double,lat:double>"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_KM * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))  # least() would turn a null into 1


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def metres_per_degree(lat: Column) -> Column:
    """struct(lon, lat): metres of a degree at a latitude, by the usual cosine series."""
    p = F.radians(lat)
    along = 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)
    up = 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)
    return F.struct(along.alias("lon"), up.alias("lat"))


def bbox_distance_km(lat: Column, lon: Column, box: dict[str, Column], at_lat: Column | None = None, at_lon: Column | None = None) -> Column:
    """From a point to a box, planar at the point's latitude; else to a stored place; else null, which is farther than anything."""
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in box.values()])
    dx = F.greatest(box["min_lon"] - lon, F.lit(0.0), lon - box["max_lon"]) * F.cos(F.radians(lat))
    dy = F.greatest(box["min_lat"] - lat, F.lit(0.0), lat - box["max_lat"])
    near = F.radians(F.sqrt(dx * dx + dy * dy)) * EARTH_KM
    return F.when(whole, near).otherwise(F.lit(None) if at_lat is None else haversine_km(lat, lon, at_lat, at_lon))


def bbox_overlap_deg2(a: dict[str, Column], b: dict[str, Column]) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("min_lon", "max_lon") * side("min_lat", "max_lat")


def bbox_gap_km(a: dict[str, Column], b: dict[str, Column]) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.greatest(a[lo], b[lo]) - F.least(a[hi], b[hi]))
    x, y = side("min_lon", "max_lon"), side("min_lat", "max_lat")
    return F.sqrt(x * x + y * y) * 111.0


def extents_agree(a: dict[str, Column], b: dict[str, Column], tol: float = 0.05) -> Column:
    mid = lambda d, ax: (d[f"min_{ax}"] + d[f"max_{ax}"]) / 2
    return (F.abs(mid(a, "lon") - mid(b, "lon")) <= tol) & (F.abs(mid(a, "lat") - mid(b, "lat")) <= tol)


def part_length_km(part: Column) -> Column:
    """Length of a polyline; 0 for fewer than two points."""
    legs = F.transform(part, lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(haversine_km(F.get(part, i - 1)["lat"], F.get(part, i - 1)["lon"], p["lat"], p["lon"])))
    return F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)


def length_km(parts: Column) -> Column:
    return F.aggregate(F.transform(parts, part_length_km), F.lit(0.0), lambda a, x: a + x)


def max_edge_m(parts: Column) -> Column:
    """Longest step between neighbouring points, never across parts."""
    step = lambda part: F.transform(part, lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(haversine_m(F.get(part, i - 1)["lat"], F.get(part, i - 1)["lon"], p["lat"], p["lon"])))
    return F.coalesce(F.array_max(F.flatten(F.transform(parts, step))), F.lit(0.0))


def shoelace_deg2(ring: Column) -> Column:
    """Area of a ring in square degrees."""
    cross = F.transform(ring, lambda p, i: p["lon"] * F.get(ring, (i + 1) % F.size(ring))["lat"] - F.get(ring, (i + 1) % F.size(ring))["lon"] * p["lat"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def area_ha(ring: Column, lat: Column) -> Column:
    """Area of a ring in hectares at a latitude."""
    return shoelace_deg2(ring) * F.lit(111.32 * 111.32 * 100) * F.cos(F.radians(lat))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray casting; a point on the border counts by half-open latitudes."""

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + F.size(ring) - 1) % F.size(ring))
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"])

    flips = F.transform(ring, lambda p, i: F.coalesce(crosses(p, i), F.lit(False)).cast("int"))
    return F.aggregate(flips, F.lit(0), lambda a, x: a + x) % 2 == 1


def extent(parts: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of a geometry; null without points or with any that isn't finite."""
    pts = F.flatten(parts)
    lon, lat = F.transform(pts, lambda p: p["lon"]), F.transform(pts, lambda p: p["lat"])
    bad = F.exists(pts, lambda p: p["lon"].isNull() | p["lat"].isNull() | F.isnan(p["lon"]) | F.isnan(p["lat"]))
    return F.when((F.size(pts) > 0) & ~bad, F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat")))


def round_part(part: Column, digits: int = 5) -> Column:
    """Rounded points without neighbours that are then equal."""
    r = F.transform(part, lambda p: F.struct(F.round(p["lon"], digits).alias("lon"), F.round(p["lat"], digits).alias("lat")))
    return F.filter(r, lambda p, i: (i == 0) | (F.get(r, i - 1) != p))


def coordinate_count(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.size(p))


def merge_parts(parts: Column) -> Column:
    """Grouped geometries as one, in the order of a preceding sort."""
    return F.flatten(F.collect_list(parts))


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    """Part of a segment within (min_lon, min_lat, max_lon, max_lat), by its entering and leaving parameters; null outside."""
    dx, dy = x1 - x0, y1 - y0
    enter, leave, off = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, x0 - box[0]), (dx, box[2] - x0), (-dy, y0 - box[1]), (dy, box[3] - y0)):
        off = off | ((p == 0) & (q < 0))
        t = F.when(p != 0, q / F.when(p != 0, p))
        enter = F.greatest(enter, F.when(p < 0, t).otherwise(F.lit(0.0)))
        leave = F.least(leave, F.when(p > 0, t).otherwise(F.lit(1.0)))
    at = lambda t: F.struct((x0 + t * dx).alias("lon"), (y0 + t * dy).alias("lat"))
    return F.when(~off & (enter <= leave), F.struct(at(enter).alias("a"), at(leave).alias("b")))


def cell(lon: Column, lat: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lon / F.lit(size)).cast("long"), F.floor(lat / F.lit(size)).cast("long")
