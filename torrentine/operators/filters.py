"""Filters and projections of the map views. Empty lists of choices put no condition; each null rule is stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def among(c: Column, values: list) -> Column:
    """Membership; no values means no condition, a null never belongs."""
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(True)


def contracted_view(waters: DataFrame, counties=(), localities=(), kinds=(), pin: str | None = None) -> DataFrame:
    """Contracted waters of the chosen counties, localities and kinds.

    A pinned slug that only its locality hides comes back. With counties chosen, the geometry is the
    county's clip if there is one (see :func:`clip_state`), and a clip that is null hides the water, pinned or not.
    """
    rows = waters.where("contracted")
    county, kind = among(F.col("judet"), list(counties)), among(F.col("kind"), list(kinds))
    show = county & kind & among(F.col("locality"), list(localities))
    if pin is not None:
        show = show | (F.col("slug") == pin) & county & kind
    rows = rows.where(show)
    return rows.where(clip_state(F.col("clips"), F.col("judet")) != "hidden") if counties and "clips" in waters.columns else rows


def uncontracted_view(waters: DataFrame, counties=(), localities=(), kinds=(), only_contracted: bool = False, pin: str | None = None) -> DataFrame:
    """The mirror for uncontracted waters: nothing if only contracted ones are wanted; its pin is never clipped."""
    rows = waters.where("not contracted")
    if only_contracted:
        return rows.where(F.lit(False))
    county, kind = among(F.col("judet"), list(counties)), among(F.col("kind"), list(kinds))
    show = county & kind & among(F.col("locality"), list(localities))
    return rows.where(show | (F.col("slug") == pin) & county & kind if pin is not None else show)


def clip_state(clips: Column, county: Column) -> Column:
    """original (no map, or no such key), hidden (a null under the key) or clip."""
    known = F.coalesce(F.map_contains_key(clips, county), F.lit(False))
    return F.when(~known, "original").when(F.try_element_at(clips, county).isNull(), "hidden").otherwise("clip")


def lod_thresholds(zoom: float, by_locality: bool = False) -> tuple[float, float]:
    """Least length in km and area in ha that a zoom shows."""
    if by_locality or zoom >= 10:
        return 0.0, 0.0
    return (30.0, 100.0) if zoom < 8 else (10.0, 10.0)


def passes_lod(area: Column, length: Column, least_km: float, least_ha: float) -> Column:
    """Area counts if there is one, else length; a water with neither passes."""
    return F.coalesce(area >= least_ha, length >= least_km, F.lit(True))


def in_view(view: tuple[float, float, float, float], pad: float = 0.25) -> Column:
    """The box meets a view padded by a share of its extent, edges included; no box passes."""
    dx, dy = (view[2] - view[0]) * pad, (view[3] - view[1]) * pad
    meets = (F.col("max_lon") >= view[0] - dx) & (F.col("min_lon") <= view[2] + dx) & (F.col("max_lat") >= view[1] - dy) & (F.col("min_lat") <= view[3] + dy)
    return F.coalesce(meets, F.lit(True))


def cull(waters: DataFrame, zoom: float, view: tuple[float, float, float, float], pins: DataFrame | None = None, by_locality: bool = False) -> DataFrame:
    """Pinned waters, and those that the zoom shows within the view. pins: a frame with column slug."""
    shown = passes_lod(F.col("area_ha"), F.col("length_km"), *lod_thresholds(zoom, by_locality)) & in_view(view)
    if pins is None:
        return waters.where(shown)
    pinned = pins.select(F.col("slug").alias("pin")).distinct()
    return waters.join(pinned, F.col("slug") == F.col("pin"), "left").where(F.col("pin").isNotNull() | shown).drop("pin")


def pin_set(waters: DataFrame, selected: str, association: str) -> DataFrame:
    """Slugs of the selected water and of all members of an association."""
    return waters.where((F.col("slug") == selected) | (F.col("association_id") == association)).select("slug").distinct()


def feature_place(lon: Column, lat: Column, has_geometry: Column) -> Column:
    """struct(kind, lon, lat): the geometry; else the stored place or the middle of the box; else a hidden default."""
    box = [F.col(c) for c in BOX]
    mid_lon, mid_lat = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    fallback = mid_lon.isNotNull() & mid_lat.isNotNull()
    return F.struct(
        F.when(has_geometry, "geometry").when(fallback, "bbox_fallback").otherwise("hidden").alias("kind"),
        F.when(has_geometry | fallback, F.coalesce(lon, mid_lon)).otherwise(F.lit(25.0)).alias("lon"),
        F.when(has_geometry | fallback, F.coalesce(lat, mid_lat)).otherwise(F.lit(45.8)).alias("lat"),
    )


def explicit_interval(start: Column, end: Column) -> Column:
    """Both are numbers with 0 <= start < end <= 1."""
    return F.coalesce(~F.isnan(start) & ~F.isnan(end) & (start >= 0) & (start < end) & (end <= 1), F.lit(False))


def precut(geometry_kind: Column, parts: Column) -> Column:
    return F.coalesce((geometry_kind == "sector") & F.exists(parts, lambda p: F.size(p) >= 2), F.lit(False))


BLOCKING = ("ambiguous_course", "no_course", "unparsed")


def eligible(status: Column, has_override: Column, reasons: Column) -> Column:
    """Resolved sectors; those in review only by an override and without a blocking reason."""
    blocked = F.exists(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r.startswith("invariant:") | r.isin(*BLOCKING))
    return F.coalesce((status == "resolved") | (status == "review") & has_override & ~blocked, F.lit(False))


def keep_tags(tags: Column, exact: list[str], prefixes: list[str]) -> Column:
    """Tags of the whitelisted keys and key prefixes."""
    return F.map_filter(tags, lambda k, v: k.isin(*exact) | k.rlike("^(?:" + "|".join(prefixes) + ")"))


def area_wanted(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit("admin_level")).isin("2", "4", "8"), F.lit(False)) | F.map_contains_key(tags, "water") | F.map_contains_key(tags, "landuse") | F.coalesce(F.try_element_at(tags, F.lit("natural")) == "water", F.lit(False))


def candidates(rows: DataFrame, keys: Column, wanted: DataFrame) -> DataFrame:
    """Rows of which any key is wanted; wanted has column key. Rows need column slug."""
    hit = rows.select("slug", F.explode(keys).alias("key")).join(wanted.select("key").distinct(), "key", "left_semi").select("slug").distinct()
    return rows.join(hit, "slug", "left_semi")


def majors(rows: DataFrame, least_km: float = 30.0, least_ha: float = 100.0) -> DataFrame:
    """Rivers of a length, then lakes of an area; no size counts as zero."""
    rivers = rows.where((F.col("kind") == "river") & (F.coalesce("length_km", F.lit(0.0)) >= least_km))
    return rivers.unionByName(rows.where((F.col("kind") == "lake") & (F.coalesce("area_ha", F.lit(0.0)) >= least_ha)))


def fallback_wanted(rows: DataFrame, wanted: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows whose (stem, county) is wanted and whose name is not covered by something at least as long."""
    keep = rows.join(wanted.select("stem", "judet").distinct(), ["stem", "judet"], "left_semi")
    return keep.join(covered.select(F.col("stem").alias("s"), F.col("length_km").alias("have")), (F.col("stem") == F.col("s")) & (F.col("have") >= F.col("length_km")), "left_anti")


def retention(min_cm: Column, explicit: Column) -> Column:
    """forbidden if the rule says so in either field; a number above zero is a least size; else what is stated; else unconfirmed."""
    stated, text = F.lower(F.coalesce(explicit, F.lit(""))), F.lower(F.coalesce(min_cm, F.lit("")))
    size = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(stated.rlike("interzis") | text.rlike("interzis"), "interzis").when(size > 0, "dimensiune").when(stated != "", stated).otherwise("neconfirmat")


def published(is_public: Column, status: Column, version: Column) -> Column:
    return F.coalesce(is_public & (status == "approved") & (version == 1), F.lit(False))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule is true of what is fine, null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def strict(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The rows, or an error naming the first broken rule as they are read."""
    out = rows
    for name, ok in rules.items():
        message = F.concat(F.lit(f"{name}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        out = out.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return out


def lenient(rows: DataFrame, ok: Column) -> DataFrame:
    """Malformed rows are dropped."""
    return rows.where(F.coalesce(ok, F.lit(False)))
