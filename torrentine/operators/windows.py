"""Analytic operators: intervals on a course, running measures, islands, ranks, top-k and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torrentine.functions.geo import bbox_distance_km, haversine_m
from torrentine.functions.text import course_rank
from torrentine.operators.joins import holding
from torrentine.sources.scratch import checkpointed


def positions(rows: DataFrame, group: str, order: str) -> DataFrame:
    """f: the place of each member on its course, [0, 1]: the stored one, else its rank spread evenly; a lone one is in the middle."""
    w = Window.partitionBy(group).orderBy(course_rank(F.col("name")), order)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    spread = F.when(n <= 1, F.lit(0.5)).otherwise((F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1)))
    return rows.withColumn("n_group", n).withColumn("i_rank", F.row_number().over(w)).withColumn("f", F.coalesce(F.col("course_frac"), spread))


def voronoi(rows: DataFrame, group: str, order: str, open_ends: bool = False) -> DataFrame:
    """v_from, v_to: from the middle to the one before to the middle to the one after; the ends are 0 and 1, or open for clicks."""
    p = positions(rows, group, order)
    w = Window.partitionBy(group).orderBy("f", "i_rank")
    lo, hi = (F.lit(float("-inf")), F.lit(float("inf"))) if open_ends else (F.lit(0.0), F.lit(1.0))
    p = p.withColumn("v_from", F.coalesce((F.lag("f").over(w) + F.col("f")) / 2, lo)).withColumn("v_to", F.coalesce((F.lead("f").over(w) + F.col("f")) / 2, hi))
    if not open_ends:
        p = p.withColumn("v_from", F.when(F.col("n_group") <= 1, F.lit(0.0)).otherwise(F.col("v_from"))).withColumn("v_to", F.when(F.col("n_group") <= 1, F.lit(1.0)).otherwise(F.col("v_to")))
    return p


def contract_intervals(rows: DataFrame, group: str, order: str) -> DataFrame:
    """i_from, i_to: the stated interval, else the Voronoi one."""
    own = F.col("sector_start").isNotNull() & F.col("sector_end").isNotNull()
    v = voronoi(rows, group, order)
    return v.withColumn("i_from", F.when(own, F.col("sector_start")).otherwise(F.col("v_from"))).withColumn("i_to", F.when(own, F.col("sector_end")).otherwise(F.col("v_to")))


def contract_at(clicks: DataFrame, rows: DataFrame, group: str, order: str, item: str = "slug") -> DataFrame:
    """clicks (group, frac) with the contract there: the shortest stated interval that holds it, else the Voronoi owner; none in groups of one."""
    v = voronoi(rows, group, order, open_ends=True).where("n_group > 1").select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(order).alias("_o"), "i_rank", "v_from", "v_to", F.col("sector_start").cast("double").alias("_s"), F.col("sector_end").cast("double").alias("_e"))
    # of equal intervals only the first can be picked, and places of a group are asked once each
    stated = v.where("_s < _e").groupBy("_g", F.col("_s").alias("_from"), F.col("_e").alias("_to")).agg(F.min(F.struct("_o", "_i")).alias("_st"))
    owned = v.where("v_from < v_to").groupBy("_g", F.col("v_from").alias("_from"), F.col("v_to").alias("_to")).agg(F.min(F.struct("i_rank", "_o", "_i")).alias("_ow"))
    places = clicks.select(group, "frac").distinct()
    hit = holding(places, stated.unionByName(owned, allowMissingColumns=True), group, "frac", "_g", "_from", "_to")
    by_stated = F.when(F.col("_st").isNotNull(), F.struct((F.col("_to") - F.col("_from")).alias("len"), "_st"))
    best = hit.groupBy(F.col(group).alias("_bg"), F.col("frac").alias("_bf")).agg(F.min(by_stated).alias("_s"), F.min("_ow").alias("_w")).select("_bg", "_bf", F.coalesce("_s._st._i", "_w._i").alias(item))
    return clicks.join(best, F.col(group).eqNullSafe(F.col("_bg")) & F.col("frac").eqNullSafe(F.col("_bf"))).select(*clicks.columns, item)


def running(rows: DataFrame, partition: list[str], order: list, value: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_measure(points: DataFrame, line: str, order: str) -> DataFrame:
    """step_m and m: the step to each vertex and the running length."""
    w = Window.partitionBy(line).orderBy(order)
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return running(points.withColumn("step_m", step), [line], [order], F.col("step_m"), "m")


def part_fractions(parts: DataFrame, geometry: str, order: str, length: str) -> DataFrame:
    """f_from, f_to: running shares of the length over ordered parts; null without any."""
    w = Window.partitionBy(geometry)
    run = F.sum(length).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.nullif(F.sum(length).over(w), F.lit(0.0))
    return parts.withColumn("f_from", (run - F.col(length)) / total).withColumn("f_to", run / total)


def islands(rows: DataFrame, partition: list[str], order: str, flag: Column, *aggs: Column) -> DataFrame:
    """Runs of consecutive rows with the flag: partition, island number, first and last of ``order``, n, and more aggregates."""
    w = Window.partitionBy(*partition).orderBy(order)
    rows = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    start = (F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))).cast("int")
    rows = rows.withColumn("_s", start).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_f").groupBy(*partition, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), *aggs)


def trim_near_runs(rows: DataFrame, line: str, order: str, near: Column, step: str, least_m: float) -> DataFrame:
    """Rows without runs of near points that are ``least_m`` or longer; shorter runs stay."""
    w = Window.partitionBy(line).orderBy(order)
    rows = rows.withColumn("_n", F.coalesce(near, F.lit(False)))
    turn = (F.col("_n") != F.coalesce(F.lag("_n").over(w), ~F.col("_n"))).cast("int")
    rows = rows.withColumn("_t", turn).withColumn("_run", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    long = F.sum(step).over(Window.partitionBy(line, "_run")) >= least_m
    return rows.withColumn("_long", long).where("not (_n and _long)").drop("_n", "_t", "_run", "_long")


def coalesce_intervals(rows: DataFrame, partition: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Intervals of a partition with gaps of at most ``gap`` as one."""
    w = Window.partitionBy(*partition).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col(start) - before > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*partition, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def max_edge(points: DataFrame, item: str, part: str, order: str) -> DataFrame:
    """Longest step in metres of each item, never across parts."""
    w = Window.partitionBy(item, part).orderBy(order)
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("_s", step).groupBy(item).agg(F.coalesce(F.max("_s"), F.lit(0.0)).alias("max_edge_m"))


def adjacent_overlaps(rows: DataFrame, key: str, item: str, start: str, end: str) -> DataFrame:
    """(key, item, next_item): neighbours by start where the next begins before this one ends."""
    w = Window.partitionBy(key).orderBy(start, item)
    rows = rows.withColumn("next_item", F.lead(item).over(w)).withColumn("_ns", F.lead(start).over(w))
    return rows.where(F.col("_ns") < F.col(end)).select(key, item, "next_item")


def ambiguity(candidates: DataFrame, key: str, score: str, place: str, tie: str, gap: float = 0.1, far: float = 200.0) -> DataFrame:
    """The first candidate of each key; ambiguous if the second is within ``gap`` and more than ``far`` away."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(place), F.asc(tie))
    c = candidates.withColumn("_r", F.row_number().over(w)).withColumn("_s", F.lead(score).over(w)).withColumn("_p", F.lead(place).over(w))
    close = F.coalesce((F.round(F.col(score) - F.col("_s"), 9) < gap) & (F.abs(F.col(place) - F.col("_p")) > far), F.lit(False))
    return c.where("_r = 1").withColumn("ambiguous", close).drop("_r", "_s", "_p")


def occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """nth and total number of a key's occurrences."""
    w = Window.partitionBy(key)
    return rows.withColumn("nth", F.row_number().over(w.orderBy(order))).withColumn("total", F.count(F.lit(1)).over(w))


BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def with_distance(waters: DataFrame, lat: float, lon: float) -> DataFrame:
    """km from a position to each water's box, else to its place; null without either. Rounded to metres, so ranks are exact."""
    km = bbox_distance_km(F.lit(lat), F.lit(lon), {c: F.col(c) for c in BOX}, F.col("lat"), F.col("lon"))
    return waters.withColumn("km", F.round(km, 3))


def nearest(waters: DataFrame, lat: float, lon: float, limit: int = 10, max_km: float | None = None, order: str = "ord") -> DataFrame:
    """The ``limit`` nearest waters within ``max_km``: a top-k per task, then one of those."""
    d = with_distance(waters, lat, lon).where("km is not null")
    return (d if max_km is None else d.where(F.col("km") <= max_km)).orderBy("km", order).limit(limit)


def adaptive_nearest(waters: DataFrame, lat: float, lon: float, limit: int = 10, radii: tuple[float, ...] = (25.0, 50.0), enough: int = 3, order: str = "ord") -> DataFrame:
    """The nearest waters within the first radius that holds ``enough``; else the nearest at any distance. Adds radius_km.

    Only the nearest ``limit`` rows matter to the choice: whether a radius holds enough shows in them, so one top-k decides.
    """
    top = nearest(waters, lat, lon, max(limit, enough), None, order)
    whole = Window.orderBy("km", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = top.withColumn("_rank", F.row_number().over(Window.orderBy("km", order)))
    radius = F
    for r in radii:
        radius = radius.when(F.sum((F.col("km") <= r).cast("int")).over(whole) >= enough, F.lit(r))
    widest = F.greatest(F.lit(radii[-1]), F.ceil(F.max("km").over(whole) / 10) * 10.0)
    top = top.withColumn("radius_km", radius.otherwise(widest).cast("double"))
    return top.where((F.col("km") <= F.col("radius_km")) & (F.col("_rank") <= limit)).drop("_rank")


def render_order(rows: DataFrame, is_precut: Column, km: str, order: str) -> DataFrame:
    """Others first as they come, then pre-cut sectors from the longest on; z numbers them."""
    keys = [is_precut.asc(), F.when(is_precut, F.col(km)).desc_nulls_last(), F.col(order).asc()]
    return rows.orderBy(*keys)


def render_positions(rows: DataFrame, is_precut: Column, km: str, order: str) -> DataFrame:
    """``rows`` with z, the place in :func:`render_order` from 1 on; ``order`` breaks all ties.

    Ranges of rows are sorted each by itself and cut off from how they came about, so that their sizes, which place the next ranges, stay true.
    """
    w = Window.orderBy("_r")
    dealt = render_order(rows, is_precut, km, order).withColumn("_r", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    dealt = checkpointed(dealt)
    sizes = dealt.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))  # one row a range
    return dealt.join(F.broadcast(before), "_r").withColumn("z", F.col("_before") + F.col("_i") + 1).drop("_r", "_i", "_before")


def top_reasons(rows: DataFrame, reasons: Column, limit: int = 15) -> DataFrame:
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(limit)


def pick_best(rows: DataFrame, key: str, value: str, *rank: Column) -> DataFrame:
    """(key, value) of the greatest rank; the last rank must break ties."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias(value))


def manifest_diff(expected: DataFrame, actual: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, state): missing, changed or new; what is in neither state is the same."""
    a, b = expected.select(path, F.col(digest).alias("was")), actual.select(path, F.col(digest).alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, path, "full").select(path, state.alias("state")).where("state is not null")


def unexpected(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(allowed.select(key).distinct(), key, "left_anti")


def unique_in_order(*values: Column) -> Column:
    """Values that aren't empty, each once, in order."""
    return F.array_distinct(F.filter(F.array(*values), lambda x: x.isNotNull() & (x != "")))
