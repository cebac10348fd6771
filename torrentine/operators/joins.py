"""Joins: keyed, fuzzy, as-of, interval and spatial ones. No cross joins; every theta condition has an equality of cells, tokens or keys to go by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torrentine.functions.geo import haversine_m


def group_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array; none is an empty array."""
    packed = children.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    kind = packed.schema[name].dataType
    return parents.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def lookup(ranked: DataFrame, waters: DataFrame, key: str = "slug") -> DataFrame:
    """Ranked keys with their rows; keys without one drop out."""
    return ranked.join(waters, key)


def first_match(pools: list[DataFrame], key: str) -> DataFrame:
    """Each key's row in the first pool that has it; pools share a schema."""
    rows = None
    for i, p in enumerate(pools):
        p = p.withColumn("pool", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct("pool", *[c for c in rest if c != "pool"])).alias("r")).select(key, "r.*")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], checks: dict[str, tuple[str, str]]) -> DataFrame:
    """Inner join on composite keys with, per row, the names of the checks (left column = right column) that fail."""
    right = right.select(*keys, *[F.col(r).alias(f"{r}__right") for _, r in checks.values()])
    failed = F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(f"{b}__right")), F.lit(n)) for n, (a, b) in checks.items()]))
    return left.join(right, keys).withColumn("failed", failed).drop(*[f"{b}__right" for _, b in checks.values()])


def merge_if_missing(published: DataFrame, source: DataFrame, key: str, order: str, better: Column, fields: list[str]) -> DataFrame:
    """Published rows, a field taken from the source where it is missing or ``better``; new source keys are added, the first of each.

    ``better`` may name columns of either side, the source's with prefix ``s_``. Adds column change: kept, upgraded, inserted.
    """
    first = source.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("rn = 1")
    first = first.select(key, *[F.col(f).alias(f"s_{f}") for f in fields], F.lit(True).alias("s_has"))
    both = published.withColumn("p_has", F.lit(True)).join(first, key, "full")
    take = F.coalesce(F.col("s_has"), F.lit(False)) & (F.col("p_has").isNull() | F.coalesce(better, F.lit(False)))
    cols = [F.when(take, F.coalesce(F.col(f"s_{f}"), F.col(f))).otherwise(F.col(f)).alias(f) for f in fields]
    change = F.when(F.col("p_has").isNull(), "inserted").when(take, "upgraded").otherwise("kept")
    return both.select(key, *cols, change.alias("change"))


def trace(targets: DataFrame, source: DataFrame, strategies: list[tuple[str, list[tuple[str, str]]]], target_id: str, source_id: str) -> DataFrame:
    """(target_id, n_hits, best, verdict): equi-joins by several strategies, hits told once.

    A strategy is a name and pairs of (target column, source column). One hit is traced, by another than the first strategy
    suspect if several agree on none, more are ambiguous, none is untraced.
    """
    hits = None
    for rank, (_, pairs) in enumerate(strategies):
        cond = None
        for a, b in pairs:
            c = targets[a] == source[b]
            cond = c if cond is None else cond & c
        h = targets.join(source, cond).select(targets[target_id].alias("t"), source[source_id].alias("s"), F.lit(rank).alias("rank"))
        hits = h if hits is None else hits.unionByName(h)
    once = hits.groupBy("t", "s").agg(F.min("rank").alias("rank"))
    summed = once.groupBy("t").agg(F.count(F.lit(1)).alias("n_hits"), F.min("rank").alias("best"))
    verdict = F.when(F.col("n_hits").isNull(), "untraced").when(F.col("n_hits") > 1, "ambiguous").when(F.col("best") > 0, "suspect").otherwise("traced")
    ids = targets.select(target_id)
    return ids.join(summed, ids[target_id] == summed.t, "left").select(target_id, F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), "best", verdict.alias("verdict"))


def token_overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: Column, right_tokens: Column, least: float = 0.6, least_shared: int = 1) -> DataFrame:
    """(left_id, right_id, shared, score): the best right row of each left one by shared distinct tokens over the larger set.

    Candidates share a token and have sizes that the score allows; it is counted from the joined tokens alone. Ties go to the smaller right id.
    """
    l = left.select(F.col(left_id).alias("l"), F.array_distinct(left_tokens).alias("lt"))  # noqa: E741
    r = right.select(F.col(right_id).alias("r"), F.array_distinct(right_tokens).alias("rt"))
    lx = l.select("l", F.size("lt").alias("ln"), F.explode("lt").alias("token"))
    rx = r.select("r", F.size("rt").alias("rn"), F.explode("rt").alias("token"))
    smaller, larger = F.least("ln", "rn"), F.greatest("ln", "rn")
    sizes = (smaller / larger >= least) & (smaller >= least_shared)
    pairs = lx.join(rx, "token").where(sizes).groupBy("l", "r", "ln", "rn").agg(F.count(F.lit(1)).alias("shared"))
    scored = pairs.withColumn("score", F.col("shared") / F.greatest("ln", "rn")).where((F.col("score") >= least) & (F.col("shared") >= least_shared))
    best = scored.groupBy("l").agg(F.max(F.struct("score", (-F.col("r")).alias("neg"), "shared")).alias("b"))
    return best.select(F.col("l").alias(left_id), (-F.col("b.neg")).alias(right_id), F.col("b.shared").alias("shared"), F.col("b.score").alias("score"))


def best_by(rows: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """(key, value) of the row that comes first by ``order``, which must be total."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, value)


def keyed_tier(left: DataFrame, left_id: str, key: str, right: DataFrame, right_id: str, right_key: str) -> DataFrame:
    """A tier of (left_id, match) by equal keys: of a key's rows on the right the least and the greatest, which tell whether it has one and which."""
    ends = right.groupBy(F.col(right_key).alias("_k")).agg(F.array_distinct(F.array(F.min(right_id), F.max(right_id))).alias("m"))
    return left.join(ends, F.col(key) == F.col("_k")).select(left_id, F.explode("m").alias("match"))


def tiered_match(left: DataFrame, left_id: str, tiers: list[DataFrame]) -> DataFrame:
    """(left_id, match, tier, status) from tiers of (left_id, match): the first tier with any hit decides.

    One hit is matched, several are ambiguous and final, none at all is unmatched. The least match stands for its tier.
    """
    rows = None
    for i, t in enumerate(tiers):
        t = t.select(F.col(left_id), "match", F.lit(i + 1).alias("tier"))
        rows = t if rows is None else rows.unionByName(t)
    per = rows.distinct().groupBy(left_id, "tier").agg(F.min("match").alias("match"), F.count(F.lit(1)).alias("n"))
    first = per.groupBy(left_id).agg(F.min(F.struct("tier", "match", "n")).alias("b"))
    out = left.select(left_id).join(first, left_id, "left")
    status = F.when(F.col("b").isNull(), "unmatched").when(F.col("b.n") > 1, "ambiguous").otherwise("matched")
    return out.select(left_id, F.when(status == "matched", F.col("b.match")).alias("match"), F.col("b.tier").alias("tier"), status.alias("status"))


def score_candidates(hits: DataFrame, key: str, candidate: str, name: Column, mention: Column, length_fit: Column, gap: float = 0.1, keep: int = 5) -> DataFrame:
    """Candidates ranked by .6 name + .2 mention + .2 length fit, ties by candidate; the first is ambiguous if the next is within ``gap``."""
    score = 0.6 * name + 0.2 * mention + 0.2 * length_fit
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc(candidate))
    ranked = hits.select(key, candidate, F.round(score, 9).alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    close = (F.col("rank") == 1) & F.coalesce(F.round(F.col("score") - F.col("next"), 9) < gap, F.lit(False))
    return ranked.where(F.col("rank") <= keep).select(key, candidate, "score", "rank", close.alias("ambiguous"))


def prefer_longer(matches: DataFrame) -> DataFrame:
    """A match much shorter than its contract gives way to the fallback if that is long enough.

    Columns length_km, contract_km, fallback_km; adds ``source``: primary or fallback.
    """
    short = F.col("length_km") < 0.6 * F.col("contract_km")
    fits = (F.col("fallback_km") >= 0.8 * F.col("contract_km")) | (F.col("fallback_km") >= 2 * F.col("length_km"))
    return matches.withColumn("source", F.when(F.coalesce(short & fits, F.lit(False)), "fallback").otherwise("primary"))


def key_index(rows: DataFrame, value: str, *keys: Column) -> DataFrame:
    """(key, value) for each distinct key of a row."""
    return rows.select(F.explode(F.array_distinct(F.concat(*keys))).alias("key"), value).where("key <> ''").distinct()


def county_penalty(distance_deg: Column) -> Column:
    """By distance to the county's centre: up to one degree a small bonus, up to two a small penalty, else a large one."""
    return F.when(distance_deg <= 1, -0.02 * (1 - distance_deg)).when(distance_deg <= 2, F.lit(0.15)).otherwise(F.lit(0.3))


def pick_cluster(targets: DataFrame, clusters: DataFrame, target_id: str, cluster_id: str, key: str, distance_deg: Column) -> DataFrame:
    """(target_id, cluster_id, score): of the clusters of a target's name the one nearest to its county, by one less the penalty; of equals the least."""
    score = F.round(1 - county_penalty(distance_deg), 9)
    near = targets.join(clusters, key).select(target_id, cluster_id, score.alias("score"))
    best = near.groupBy(target_id).agg(F.min(F.struct((-F.col("score")).alias("neg"), cluster_id)).alias("b"))
    return best.select(target_id, F.col(f"b.{cluster_id}").alias(cluster_id), (-F.col("b.neg")).alias("score"))


#: So few intervals of a key share one cell: comparing them all costs less than dealing them out.
FEW = 32


def key_cells(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(_k, _lo, _hi, _w): per key the extent of its intervals and the width of its cells, their mean length.

    An interval without a finite end is as long as the extent, so all intervals of a key cover at most three times as many cells
    as there are intervals, whatever their lengths; one far longer than the rest makes the cells of its key coarser. A key with few
    intervals has one cell.
    """
    s, e, inf = F.col(start).cast("double"), F.col(end).cast("double"), F.lit(float("inf"))
    finite = lambda x: F.abs(x) < inf
    lo, hi = F.min(F.when(finite(s), s).when(finite(e), e)), F.max(F.when(finite(e), e).when(finite(s), s))
    whole = finite(s) & finite(e)
    per = rows.where(F.col(start) <= F.col(end)).groupBy(F.col(key).alias("_k")).agg(
        F.coalesce(lo, F.lit(0.0)).alias("_lo"), F.coalesce(hi, F.lit(0.0)).alias("_hi"), F.sum(F.when(whole, e - s).otherwise(0.0)).alias("_sum"), F.count_if(~whole).alias("_open"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_sum") + F.col("_open") * (F.col("_hi") - F.col("_lo"))) / F.col("_n")
    return per.select("_k", "_lo", "_hi", F.when((width > 0) & (F.col("_n") > FEW), width).otherwise(F.col("_hi") - F.col("_lo") + 1.0).alias("_w"))


def cell_of(x: Column) -> Column:
    """The cell of a place among those of :func:`key_cells`; places beyond the extent are in the outermost."""
    return F.floor((F.least(F.greatest(x.cast("double"), F.col("_lo")), F.col("_hi")) - F.col("_lo")) / F.col("_w"))


def in_cells(rows: DataFrame, grid: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows once for each cell (_c) that their interval covers, with the grid of their key; those that end before they start have none."""
    rows = rows.where(F.col(start) <= F.col(end)).join(grid, F.col(key) == F.col("_k"))
    return rows.withColumn("_c", F.explode(F.sequence(cell_of(F.col(start)), cell_of(F.col(end)))))


def holding(points: DataFrame, rows: DataFrame, key: str, point: str, rows_key: str, start: str, end: str) -> DataFrame:
    """Points with each row of their key whose half-open interval holds them; points in none stay, with nulls.

    A point meets only the intervals of its cell, so a key with many intervals is many keys. Of rows' columns none may be one of points'.
    """
    grid = key_cells(rows, rows_key, start, end)
    dealt = in_cells(rows, grid, rows_key, start, end).drop("_k", "_lo", "_hi", "_w")
    placed = points.join(grid, F.col(key) == F.col("_k"), "left").withColumn("_pc", cell_of(F.col(point))).drop("_k", "_lo", "_hi", "_w")
    return placed.join(dealt, (F.col(key) == F.col(rows_key)) & (F.col("_pc") == F.col("_c")) & (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)), "left").drop("_pc", "_c")


def interval_overlaps(rows: DataFrame, key: str, item: str, start: str, end: str, least: float) -> DataFrame:
    """(key, a, b, overlap, share): pairs of one key that overlap by more than ``least``; share of the shorter. a < b.

    Of a pair the one that starts later, of equal starts the one with the greater item, is sought by its start among those that
    cover its cell. One that ends before it starts overlaps none.
    """
    grid = key_cells(rows, key, start, end)
    rows = rows.select(key, item, start, end)
    cover = in_cells(rows, grid, key, start, end).select(key, F.col(item).alias("i"), F.col(start).alias("i0"), F.col(end).alias("i1"), "_c")
    later = rows.join(grid, F.col(key) == F.col("_k")).select("_k", F.col(item).alias("j"), F.col(start).alias("j0"), F.col(end).alias("j1"), cell_of(F.col(start)).alias("_jc"))
    common = F.least("i1", "j1") - F.greatest("i0", "j0")
    first = (F.col("i0") < F.col("j0")) | (F.col("i0") == F.col("j0")) & (F.col("i") < F.col("j"))
    pairs = cover.join(later, [F.col(key) == F.col("_k"), F.col("_c") == F.col("_jc"), first, F.col("i") != F.col("j"), F.col("i0") < F.col("j1"), F.col("j0") < F.col("i1"), common > least])
    return pairs.select(key, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), common.alias("overlap"), (common / F.least(F.col("i1") - F.col("i0"), F.col("j1") - F.col("j0"))).alias("share"))


def demote_overlaps(rows: DataFrame, pairs: DataFrame, item: str, share: float = 0.5) -> DataFrame:
    """Resolved rows in a pair that overlaps by more than ``share`` go to review; all rows of a pair are marked."""
    marks = pairs.select(F.col("a").alias(item), "share").unionByName(pairs.select(F.col("b").alias(item), "share")).groupBy(item).agg(F.max("share").alias("worst"))
    out = rows.join(marks, item, "left")
    demote = F.coalesce((F.col("worst") > share) & (F.col("status") == "resolved"), F.lit(False))
    return out.withColumn("status", F.when(demote, "review").otherwise(F.col("status"))).withColumn("overlaps", F.col("worst").isNotNull()).drop("worst")


def smallest_interval(points: DataFrame, rows: DataFrame, key: str, point: str, item: str, start: str, end: str) -> DataFrame:
    """Each point's shortest half-open interval of its key that holds it, ties by item; points in none stay, with null."""
    hit = holding(points, rows.select(F.col(key).alias("_rk"), F.col(item).alias("_i"), F.col(start).alias("_s"), F.col(end).alias("_e")), key, point, "_rk", "_s", "_e")
    shortest = F.min(F.when(F.col("_s").isNotNull(), F.struct((F.col("_e") - F.col("_s")).alias("len"), "_i")))
    return hit.groupBy(*points.columns).agg(shortest.alias("_b")).select(*points.columns, F.col("_b._i").alias(item))


def nearest_value(points: DataFrame, rows: DataFrame, key: str, point: str, item: str, value: Column) -> DataFrame:
    """Each point's item of its key whose value is nearest, ties by item.

    A union sorted by value with the last and the next item of each place: one shuffle by key, no pairs.
    """
    both = points.select(key, F.col(point).alias("v"), F.lit(None).cast(rows.schema[item].dataType).alias("it"), F.lit(True).alias("is_point"))
    both = both.unionByName(rows.groupBy(key, value.alias("v")).agg(F.min(item).alias("it")).withColumn("is_point", F.lit(False)))
    pair = F.when(~F.col("is_point"), F.struct("v", "it"))
    w = Window.partitionBy(key).orderBy("v", F.col("is_point"))
    back = F.last(pair, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(pair, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.select(key, "v", "is_point", back.alias("p"), ahead.alias("n")).where("is_point")
    dp, dn = F.abs(F.col("v") - F.col("p.v")), F.abs(F.col("n.v") - F.col("v"))
    pick = F.when(F.col("p").isNull() | (dn < dp), F.col("n.it")).when(F.col("n").isNull() | (dp < dn), F.col("p.it")).otherwise(F.least("p.it", "n.it"))
    return near.select(key, F.col("v").alias(point), pick.alias(item))


def as_of(rows: DataFrame, header: Column, value: Column, order: list, partition: list[str], name: str, or_first: bool = True) -> DataFrame:
    """Each row with the value of the last header at or before it; before any header that of the first, on demand."""
    w = Window.partitionBy(*partition).orderBy(*order)
    back = F.last(F.when(header, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if or_first:
        back = F.coalesce(back, F.first(F.when(header, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn(name, back)


def nearest_row(rows: DataFrame, header: Column, at: str, order: list, partition: list[str], name: str, prefer_next: Column) -> DataFrame:
    """Each row with the place of the nearest header, before or after; a tie goes to the next one if ``prefer_next``."""
    w = Window.partitionBy(*partition).orderBy(*order)
    place = F.when(header, F.col(at))
    back = F.last(place, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(place, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumn("_b", back).withColumn("_a", ahead)
    db, da = F.col(at) - F.col("_b"), F.col("_a") - F.col(at)
    pick = F.when(F.col("_b").isNull() | (da < db), F.col("_a")).when(F.col("_a").isNull() | (db < da), F.col("_b")).when(prefer_next, F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn(name, pick).drop("_a", "_b")


def near_join(left: DataFrame, right: DataFrame, metres: float, left_id: str, right_id: str, cell_deg: float) -> DataFrame:
    """(left_id, right_id, m): pairs of places (lon, lat) within ``metres``, by grid cells.

    A left place asks the nine cells around it, so a cell must be no smaller than the distance: ``cell_deg`` degrees of
    latitude, and of longitude at 60 degrees or less.
    """
    if metres > cell_deg * 111_000 * 0.5:
        raise ValueError("cells are too small for the distance")
    grid = lambda d: d.withColumn("cx", F.floor(F.col("lon") / cell_deg).cast("long")).withColumn("cy", F.floor(F.col("lat") / cell_deg).cast("long"))
    around = F.array(*[F.struct((F.col("cx") + i).alias("x"), (F.col("cy") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    l = grid(left.select(left_id, "lon", "lat")).select(F.col(left_id), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.explode(around).alias("c"))  # noqa: E741
    r = grid(right.select(right_id, "lon", "lat")).select(F.col(right_id), F.col("lon").alias("x2"), F.col("lat").alias("y2"), "cx", "cy")
    m = haversine_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    hit = l.join(r, [F.col("c.x") == F.col("cx"), F.col("c.y") == F.col("cy"), m <= metres])
    return hit.select(left_id, right_id, m.alias("m"))


def boxes_meet(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell_deg: float) -> DataFrame:
    """(left_id, right_id) of boxes that meet: each box is dealt to the cells it covers, a pair counts in the cell of its lower corner."""
    def dealt(d: DataFrame, key: str, p: str) -> DataFrame:
        cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell_deg).cast("long"), F.floor(F.col(hi) / cell_deg).cast("long"))
        d = d.where("min_lon <= max_lon and min_lat <= max_lat")
        d = d.select(F.col(key), *[F.col(c).alias(p + c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], F.explode(cells("min_lon", "max_lon")).alias(p + "cx"), cells("min_lat", "max_lat").alias("ys"))
        return d.select("*", F.explode("ys").alias(p + "cy")).drop("ys")

    a, b = dealt(left, left_id, "a_"), dealt(right, right_id, "b_")
    meet = (F.col("a_min_lon") <= F.col("b_max_lon")) & (F.col("b_min_lon") <= F.col("a_max_lon")) & (F.col("a_min_lat") <= F.col("b_max_lat")) & (F.col("b_min_lat") <= F.col("a_max_lat"))
    corner = (F.col("a_cx") == F.floor(F.greatest("a_min_lon", "b_min_lon") / cell_deg)) & (F.col("a_cy") == F.floor(F.greatest("a_min_lat", "b_min_lat") / cell_deg))
    return a.join(b, [F.col("a_cx") == F.col("b_cx"), F.col("a_cy") == F.col("b_cy"), meet, corner]).select(left_id, right_id)


def points_in_boxes(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, cell_deg: float) -> DataFrame:
    """(point_id, box_id) of the boxes, borders included, that hold a point; the pre-filter of exact polygon tests."""
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell_deg).cast("long"), F.floor(F.col(hi) / cell_deg).cast("long"))
    b = boxes.select(box_id, "min_lon", "min_lat", "max_lon", "max_lat", F.explode(cells("min_lon", "max_lon")).alias("cx"), cells("min_lat", "max_lat").alias("ys")).select("*", F.explode("ys").alias("cy")).drop("ys")
    p = points.select(point_id, "lon", "lat", F.floor(F.col("lon") / cell_deg).cast("long").alias("px"), F.floor(F.col("lat") / cell_deg).cast("long").alias("py"))
    inside = (F.col("lon") >= F.col("min_lon")) & (F.col("lon") <= F.col("max_lon")) & (F.col("lat") >= F.col("min_lat")) & (F.col("lat") <= F.col("max_lat"))
    return p.join(b, [F.col("px") == F.col("cx"), F.col("py") == F.col("cy"), inside]).select(point_id, box_id)


def spatial_majority(hits: DataFrame, item: str, area: str) -> DataFrame:
    """(item, area, n): the area with most of an item's points; of equals the larger name."""
    n = hits.groupBy(item, area).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(item).agg(F.max(F.struct("n", area)).alias("b")).select(item, F.col(f"b.{area}").alias(area), F.col("b.n").alias("n"))


def group_owner(rows: DataFrame, group: str, item: str, suits: Column, order: str) -> DataFrame:
    """(group, owner): the first suitable member of each group, else the first at all."""
    pick = F.struct(F.when(suits, 0).otherwise(1).alias("p"), F.col(order).alias("o"), F.col(item))
    return rows.groupBy(group).agg(F.min(pick).alias("b")).select(group, F.col(f"b.{item}").alias("owner"))


def labelled_union(sources: dict[str, DataFrame]) -> DataFrame:
    """Sources of one schema below each other with their name as ``source_path``."""
    rows = None
    for name, d in sources.items():
        d = d.withColumn("source_path", F.lit(name))
        rows = d if rows is None else rows.unionByName(d)
    return rows


def with_history(reports: DataFrame, repairs: DataFrame, key_fields: list[str], order: str) -> DataFrame:
    """Reports with their repairs, joined by a hash of the key fields, in order; none is an empty array."""
    key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_fields]), 256)
    rest = [c for c in repairs.columns if c not in key_fields and c != order]
    packed = repairs.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("history"))
    kind = packed.schema["history"].dataType
    return reports.withColumn("key", key).join(packed, "key", "left").withColumn("history", F.coalesce("history", F.array().cast(kind)))


def align_sequences(rows: DataFrame, key: str, left: str, right: str, order: str, look: int = 3) -> DataFrame:
    """Ordered merge of two lists of one key; an element may skip up to ``look`` of the other list.

    Input rows (key, order, left, right), either of which may be null; output (key, left, right) pairs, right null where nothing fits.
    """
    def merge(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        a, b, j, out = list(pdf[left].dropna()), list(pdf[right].dropna()), 0, []
        for x in a:
            hit = next((k for k in range(j, min(len(b), j + look + 1)) if b[k] == x), None)
            out.append((pdf[key].iloc[0], x, None if hit is None else b[hit]))
            j = j if hit is None else hit + 1
        return pd.DataFrame(out, columns=[key, left, right])

    kinds = dict(rows.dtypes)
    return rows.select(key, left, right, order).groupBy(key).applyInPandas(merge, f"`{key}` {kinds[key]}, `{left}` {kinds[left]}, `{right}` {kinds[right]}")
