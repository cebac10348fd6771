"""From limit texts to sectors in one plan: texts are parsed, each kind of endpoint finds its candidates, and ends make sectors.

An end at a bridge comes last, as the other end and the contract's length bound it; all other ends are found at once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torrentine.functions.limits import parse_limits
from torrentine.functions.text import char_similarity, contract_km, fold, river_match_keys
from torrentine.operators import linear, sectors
from torrentine.operators.joins import near_join
from torrentine.sources.scratch import checkpointed

# Words that open the name of a place or feature without being part of it.
OPENING_WORDS = (
    "baraj barajul lac lacul acumulare acumularea pod podul cascada localitatea comuna satul sat "
    "orasul municipiul loc com jud judetul de din la cu"
).split()
NEAR_NAME, OUTLET_M, BRIDGE_M, FEATURE_M, PLACE_M, NEAR_PLACE_M, DAM_PLACE_M = 0.85, 100.0, 30.0, {"DAM": 100.0, "WATERFALL": 200.0}, 3000.0, 1000.0, 1000.0
AREA_KINDS = ("lake", "locality", "county", "country")


class World(NamedTuple):
    """What limits speak of. Geometries are arrays of lon and lat, or of rings of these.

    courses: course_id, part, keys (of its names), braids_m, receives_into; junctions: course_id, m, tributary; areas: area, kind (one of ``AREA_KINDS``), core, rings;
    ways: way_id, part, refs, names (cores), rail; features: feature_id, kind (DAM, WATERFALL), core, lon, lat; places: place_id, core, lon, lat.
    """

    courses: DataFrame
    junctions: DataFrame
    areas: DataFrame
    ways: DataFrame
    features: DataFrame
    places: DataFrame


def core(c: Column) -> Column:
    """Folded name without the words that only open it."""
    return F.trim(F.regexp_replace(fold(c), rf"^(?:(?:{'|'.join(OPENING_WORDS)})(?: |$))+", ""))


def as_steps(points: DataFrame, key: str) -> DataFrame:
    """Points (key, lon, lat) as lines of one step without length, for joins with lines."""
    zero = F.lit(0.0)
    return points.select(F.col(key).alias("id"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2"), zero.alias("m1"), zero.alias("m2"))


def specs(waters: DataFrame) -> DataFrame:
    """waters (sector_id, limits, size, judet, course_id) with their parsed limits, contract_km and in_ha."""
    size = F.lower(F.coalesce("size", F.lit("")))
    in_ha = size.contains(" ha") | F.trim(size).endswith("ha")
    named = waters.select(F.col("sector_id").cast("string").alias("sector_id"), "course_id", "judet", parse_limits("limits").alias("spec"), in_ha.alias("in_ha"), F.when(~in_ha, contract_km(F.col("size"))).alias("contract_km"))
    return named.withColumn("scope", F.col("spec.scope")).withColumn("includes_tributaries", F.col("spec.includes_tributaries"))


def endpoints(spec: DataFrame) -> DataFrame:
    """One row an end of an interval, and one a name of a list of localities, whose sector_id has the number of the name behind a #."""
    end = lambda role: F.struct(F.lit(role).alias("role"), *[F.col(f"spec.{role}.{c}").alias(c) for c in ("kind", "target", "qualifier", "locality_hint", "road_ref")], F.lit("").alias("tail"))
    none = F.lit(None).cast("string")
    name = lambda x, i: F.struct(F.lit("from").alias("role"), F.lit("LOCALITY").alias("kind"), x.alias("target"), F.lit("at").alias("qualifier"), none.alias("locality_hint"), none.alias("road_ref"), F.concat(F.lit("#"), i.cast("string")).alias("tail"))
    ends = F.when(F.col("scope") == "interval", F.array(end("from"), end("to"))).when(F.col("scope") == "locality_list", F.transform("spec.localities", name))
    e = spec.where("course_id is not null").select("sector_id", "course_id", "judet", F.explode(ends).alias("e")).select(F.concat("sector_id", "e.tail").alias("sector_id"), "course_id", "judet", "e.*").drop("tail").where("kind is not null")
    county = F.when(F.col("kind") == "BORDER", "@border").otherwise(fold(F.coalesce("target", "judet")))
    hint = F.when(F.col("kind") == "BRIDGE", core(F.col("locality_hint"))).otherwise("")
    return e.select("*", river_match_keys(F.col("target")).alias("keys"), core(F.col("target")).alias("core"), hint.alias("hint_core"), county.alias("county"))


def locality_ends(ends: DataFrame, spans: DataFrame, near_places: DataFrame, anchored: DataFrame, place_county: DataFrame) -> DataFrame:
    """Where the course enters or leaves the locality's area; else the place of that name nearest by, up to 3 km, of another county only up to 1 km and at a discount."""
    e = ends.where("kind = 'LOCALITY' and core <> ''").withColumn("first", F.when(F.col("qualifier") == "upstream", True).when(F.col("qualifier") == "downstream", False).otherwise(F.col("role") == "from"))
    held = e.join(spans.where("kind = 'locality'").select(F.col("id").alias("course_id"), F.col("core").alias("core"), "area", "enters", "leaves"), ["course_id", "core"])
    inside = sectors.found(held, "locality_area", F.when(F.col("first"), F.col("enters")).otherwise(F.col("leaves")), F.col("area"))
    p = e.join(anchored.select("sector_id", "role", "place_id"), ["sector_id", "role"]).join(near_places, ["course_id", "place_id"]).join(place_county, "place_id", "left")
    away = F.coalesce(F.col("place_county") != fold(F.col("judet")), F.lit(False)) & (fold(F.col("judet")) != "")
    p = p.withColumn("away", away).where(~F.col("away") | (F.col("dist_m") <= NEAR_PLACE_M)).withColumn("method", F.when(F.col("dist_m") <= NEAR_PLACE_M, "locality_near").otherwise("locality_far"))
    cut = lambda d, off: sectors.found(d, F.col("method"), F.col("m"), F.col("place_id")).withColumn("confidence", F.round(F.col("confidence") - off, 9))
    return sectors.fall_through([inside, cut(p.where("not away"), 0.0).unionByName(cut(p.where("away"), sectors.OUTSIDE))])


def feature_ends(ends: DataFrame, kind: str, near: DataFrame, features: DataFrame, anchored: DataFrame, named: str, by_place: str | None) -> DataFrame:
    """A feature of nearly that name near the course; else, if allowed, one within 1 km of the endpoint's place."""
    e = ends.where(F.col("kind") == kind).select("sector_id", "role", "course_id", "core")
    on = e.join(near, "course_id").join(features.where(F.col("kind") == kind).select("feature_id", F.coalesce("core", F.lit("")).alias("name"), "lon", "lat"), "feature_id").where(F.col("dist_m") <= FEATURE_M[kind])
    tiers = [sectors.found(on.where((F.col("core") != "") & (F.col("name") != "")).where(char_similarity(F.col("core"), F.col("name")) >= NEAR_NAME), named, F.col("m"), F.col("feature_id"))]
    if by_place:
        spots = anchored.select(F.struct("sector_id", "role").alias("end"), "lon", "lat")
        close = near_join(spots, features.select("feature_id", "lon", "lat"), DAM_PLACE_M, "end", "feature_id", 0.05).select("end.sector_id", "end.role", "feature_id").distinct()
        tiers.append(sectors.found(on.join(close, ["sector_id", "role", "feature_id"]), by_place, F.col("m"), F.col("feature_id")))
    return sectors.fall_through(tiers)


def county_of_places(world: World) -> DataFrame:
    """(place_id, place_county): the county whose area holds a place; of several the first by name."""
    counties = world.areas.where("kind = 'county'")
    edges = linear.area_edges(counties, "area")
    spot = linear.in_boxes(world.places.select("place_id", F.col("lon").alias("x"), F.col("lat").alias("y")), linear.area_boxes(edges), 0.25)
    held = linear.with_inside(spot, edges, 0.02).where("inside").join(counties.select("area", fold(F.col("core")).alias("county")), "area")
    return held.groupBy("place_id").agg(F.min("county").alias("place_county"))


def fixed(rows: DataFrame, ends: tuple[Column, Column], confidence: tuple[Column, Column], method: str) -> DataFrame:
    """Both ends of sectors whose scope says where they lie, with their measures and confidences."""
    both = F.array(*[F.struct(F.lit(r).alias("role"), m.cast("double").alias("m"), c.alias("confidence")) for r, m, c in zip(("from", "to"), ends, confidence)])
    return rows.select("sector_id", F.explode(both).alias("e")).select("sector_id", "e.role", "e.m", "e.confidence", F.lit(method).alias("method"), F.lit(None).cast("string").alias("anchor"))


def resolve_limits(waters: DataFrame, world: World, overrides: DataFrame | None = None, measured=linear.measured_wgs84) -> DataFrame:
    """Sectors of waters (sector_id, limits, size, judet, course_id): sector_id, scope, m_from, m_to, length_m, km_ratio, status, confidence, reasons.

    An override (sector_id, role, m) stands for its end whatever the text; two of them make a sector of a text that says nothing. A size in hectares is
    no length. Sectors without a course, with a text that says nothing or with an end that is not found are unresolved. sector_id is unique.
    """
    spark = waters.sparkSession
    kind_of_id = dict(waters.dtypes)["sector_id"]
    spec = checkpointed(specs(waters))
    steps = checkpointed(linear.line_steps(world.courses, "course_id", measured=measured))
    courses = steps.where("seq = 0").select(F.col("id").alias("course_id"), "length_m").join(world.courses.select("course_id", "braids_m", "receives_into"), "course_id")
    none = spark.createDataFrame([], "sector_id string, role string, m double")
    o = none if overrides is None else overrides.select(F.col("sector_id").cast("string").alias("sector_id"), "role", "m")
    ends = checkpointed(endpoints(spec).join(o.select("sector_id", "role"), ["sector_id", "role"], "left_anti"))
    kinds = {(r.kind, r.role) for r in ends.select("kind", "role").distinct().collect()}  # a few words; what does not occur is not planned
    asks = lambda *names: any(k in names for k, _ in kinds)
    iv = checkpointed(linear.area_intervals(steps, linear.area_edges(world.areas, "area")).join(world.areas.select("area", "kind", "core"), "area"))
    spans = iv.groupBy("id", "area", "kind", "core").agg(F.min("m_from").alias("enters"), F.max("m_to").alias("leaves"))
    anchored = checkpointed(sectors.anchors(ends.where("kind <> 'CONFLUENCE'"), world.places))

    near = lambda points, key, metres: linear.near_lines(steps, as_steps(points, key), metres).select(F.col("id").alias("course_id"), F.col("other").alias(key), "m", "dist_m")
    pool = [sectors.source_and_mouth(ends, courses)]
    if asks("CONFLUENCE"):
        outlets = steps.where("seq = last").select(F.col("id").alias("other"), F.col("x2").alias("lon"), F.col("y2").alias("lat"))
        keys = world.courses.select(F.explode("keys").alias("key"), "course_id")
        pool.append(sectors.confluences(ends, courses, courses.select("course_id", "receives_into"), world.junctions, keys, near(outlets, "other", OUTLET_M).where("course_id <> other")))
    if asks("LAKE_UPSTREAM", "LAKE_DOWNSTREAM"):
        pool.append(sectors.lake_ends(ends, iv.where("kind = 'lake'").select("id", "area", "m_from", "m_to"), world.areas.where("kind = 'lake'").select("area", "core"), steps, anchored))
    if asks("DAM", "WATERFALL"):
        near_features = near(world.features, "feature_id", max(FEATURE_M.values()))
        pool += [feature_ends(ends, "DAM", near_features, world.features, anchored, "dam_named", "dam_by_place"), feature_ends(ends, "WATERFALL", near_features, world.features, anchored, "waterfall", None)]
    if asks("LOCALITY"):
        pool.append(locality_ends(ends, spans, near(world.places, "place_id", PLACE_M), anchored, county_of_places(world)))
    if asks("COUNTY_LIMIT", "BORDER"):
        limits = iv.where("kind in ('county', 'country')").select(F.col("id").alias("course_id"), F.when(F.col("kind") == "country", "@border").otherwise(fold(F.col("core"))).alias("county"), "m_from", "m_to")
        pool.append(sectors.county_limits(ends, sectors.crossings(limits, courses)))
    found = checkpointed(sectors.with_overrides(sectors.all_of(pool), o))
    named = spec.select("sector_id", "course_id", "contract_km")
    if asks("ROAD", "BRIDGE"):
        crossings = checkpointed(linear.near_lines(steps, linear.line_steps(world.ways, "way_id", measured=measured), BRIDGE_M))
    for kind in ("ROAD", "BRIDGE"):  # the latter after all others; of two of a kind the first end bounds the other
        for role in ("from", "to"):
            if (kind, role) in kinds:
                window = sectors.bridge_windows(named, found, courses).where((F.col("role") == role) & F.lit(kind == "BRIDGE" or role == "to"))
                more = sectors.bridge_ends(ends.where((F.col("kind") == kind) & (F.col("role") == role)), crossings, world.ways, anchored, window)
                found = checkpointed(found.unionByName(more.select(*sectors.OUT)))

    whole = spec.where("scope = 'whole_course'").join(courses, "course_id")
    county = spec.where("scope = 'whole_county'").select("sector_id", "course_id", fold(F.col("spec.county")).alias("county"), "contract_km")
    stretch = sectors.whole_county(county, iv.where("kind = 'county'").select(F.col("id").alias("course_id"), fold(F.col("core")).alias("county"), "m_from", "m_to"))
    listed = sectors.ranked(found.where("sector_id like '%#%'")).where("rank = 1").groupBy(F.substring_index("sector_id", "#", 1).alias("sector_id")).agg(F.min(F.struct("m", "confidence")).alias("lo"), F.max(F.struct("m", "confidence")).alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    said = [
        found.where("sector_id not like '%#%'").join(spec.where("scope = 'interval'").select("sector_id"), "sector_id", "left_semi").select(*sectors.OUT),
        fixed(whole, (F.lit(0.0), F.col("length_m")), (F.lit(0.95),) * 2, "whole_course"),
        fixed(stretch, (F.col("m_from"), F.col("m_to")), (F.lit(0.9),) * 2, "county_interval"),
        fixed(listed, (F.col("lo.m"), F.col("hi.m")), (F.col("lo.confidence"), F.col("hi.confidence")), "locality"),
    ]
    both = o.join(spec.where("scope in ('empty', 'unparsed') and course_id is not null").select("sector_id"), "sector_id", "left_semi")
    both = both.withColumn("n", F.size(F.collect_set("role").over(Window.partitionBy("sector_id")))).where("n = 2")
    said.append(sectors.found(both, "override", F.col("m"), F.lit("override")))
    rows = sectors.resolve(spec.select("sector_id", "contract_km", "includes_tributaries"), sectors.all_of(said))

    why = rows.join(spec.select("sector_id", "scope", "in_ha", "course_id"), "sector_id").join(stretch.select("sector_id", F.col("reason").alias("stretch")), "sector_id", "left")
    unusable = F.col("scope").isin("empty", "unparsed")
    lost = F.col("m_from").isNull()
    # a reason that the scope gives takes the place of those of its two ends
    instead = F.when(unusable & lost, "limite_unusable").when(F.col("course_id").isNull(), "course_missing").when((F.col("scope") == "whole_county") & lost, "county_not_on_course").when((F.col("scope") == "locality_list") & lost, "locality_list_unresolved")
    more = F.when(unusable & ~lost, "limite_unusable_overridden")
    kept = F.filter("reasons", lambda r: ~(instead.isNotNull() & r.startswith("endpoint_")) & ~(F.col("in_ha") & (r == "contract_km_missing")))
    several = F.when(F.col("stretch").isNotNull(), F.array_distinct(F.array(F.lit("county_interval_multiple"), F.col("stretch")))).otherwise(F.array().cast("array<string>"))
    reasons = F.array_sort(F.array_distinct(F.concat(kept, several, F.array_compact(F.array(instead, more, F.when(F.col("in_ha"), "contract_unit_ha"))))))
    out = ("m_from", "m_to", "length_m", "km_ratio", "status", "confidence")
    return why.select(F.col("sector_id").cast(kind_of_id).alias("sector_id"), "scope", *out, reasons.alias("reasons"))
