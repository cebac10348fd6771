"""Queries of the map: filters, nearest waters, intervals on courses, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from torrentine.functions import geo, identity, text
from torrentine.operators import filters, joins, windows
from torrentine.plans.fixtures import WITH, contracts, table, waters
from torrentine.plans.registry import query

KM = "2 * 6371.0 * asin(least(1.0, sqrt(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2))) + 0 * ({lat2} - {lat1}))"


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return KM.format(lat1=f"({lat1})", lon1=f"({lon1})", lat2=f"({lat2})", lon2=f"({lon2})")


DIST = (
    "round(CASE WHEN min_lon IS NOT NULL THEN radians(sqrt(pow(greatest(min_lon - 25.0, 0.0, 25.0 - max_lon) * cos(radians(45.0)), 2) + pow(greatest(min_lat - 45.0, 0.0, 45.0 - max_lat), 2))) * 6371.0 ELSE "
    + km_sql("45.0", "25.0", "lat", "lon") + " END, 3)"
)
VIEW = (22.0, 44.5, 24.0, 46.0)
MEETS = "coalesce(max_lon >= 21.5 AND min_lon <= 24.5 AND max_lat >= 44.125 AND min_lat <= 46.375, true)"
LOD = "coalesce(area_ha >= 100, length_km >= 30, true)"


@query(WITH + f"""SELECT slug, kind, judet, km, radius_km FROM (
  SELECT *, CASE WHEN n25 >= 3 THEN 25.0 WHEN n50 >= 3 THEN 50.0 ELSE greatest(50.0, ceil(max(km) OVER () / 10) * 10) END AS radius_km FROM (
    SELECT *, sum(CAST(km <= 25 AS INT)) OVER () AS n25, sum(CAST(km <= 50 AS INT)) OVER () AS n50 FROM (
      SELECT slug, kind, judet, ord, {DIST} AS km FROM waters WHERE judet IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_8', 'NATION_13') AND kind <> 'pond' ORDER BY km, ord LIMIT 10)))
  WHERE km <= radius_km""")
def adaptive_nearest(spark, sf_dir):
    rows = waters(spark, sf_dir).where(filters.among(F.col("judet"), [f"NATION_{i}" for i in (1, 2, 3, 5, 8, 13)]) & (F.col("kind") != "pond"))
    return windows.adaptive_nearest(rows, 45.0, 25.0).select("slug", "kind", "judet", "km", "radius_km")


@query(WITH + f"SELECT slug, km FROM (SELECT slug, ord, {DIST} AS km FROM waters) WHERE km <= 120 ORDER BY km, ord LIMIT 25")
def nearest_topk(spark, sf_dir):
    return windows.nearest(waters(spark, sf_dir), 45.0, 25.0, 25, 120.0).select("slug", "km")


@query(WITH + "SELECT slug, judet, locality, kind FROM waters WHERE contracted AND judet IN ('NATION_3', 'NATION_4', 'NATION_7') AND (locality IN ('Loc 1', 'Loc 2', 'Loc 5') OR slug = 'w-1042') AND kind IN ('river', 'lake') ")
def contracted_view(spark, sf_dir):
    out = filters.contracted_view(waters(spark, sf_dir), ["NATION_3", "NATION_4", "NATION_7"], ["Loc 1", "Loc 2", "Loc 5"], ["river", "lake"], pin="w-1042")
    return out.select("slug", "judet", "locality", "kind")


@query(WITH + "SELECT slug, judet, kind FROM waters WHERE NOT contracted AND judet IN ('NATION_3', 'NATION_4') AND kind IN ('river', 'pond')")
def uncontracted_view(spark, sf_dir):
    return filters.uncontracted_view(waters(spark, sf_dir), ["NATION_3", "NATION_4"], [], ["river", "pond"]).select("slug", "judet", "kind")


@query(WITH + "SELECT slug, CASE WHEN ord % 5 < 2 THEN 'original' WHEN ord % 5 = 2 THEN 'hidden' WHEN ord % 5 = 3 THEN 'clip' ELSE 'original' END AS state FROM waters")
def clip_state(spark, sf_dir):
    m = F.when(F.col("ord") % 5 == 1, F.create_map(F.lit("x"), F.lit("c")))
    m = m.when(F.col("ord") % 5 == 2, F.create_map(F.col("judet"), F.lit(None).cast("string"))).when(F.col("ord") % 5 == 3, F.create_map(F.col("judet"), F.lit("c")))
    return waters(spark, sf_dir).select("slug", filters.clip_state(m, F.col("judet")).alias("state"))


@query(WITH + f"SELECT slug FROM waters WHERE {LOD}")
def lod_filter(spark, sf_dir):
    return waters(spark, sf_dir).where(filters.passes_lod(F.col("area_ha"), F.col("length_km"), *filters.lod_thresholds(7))).select("slug")


@query(WITH + f"SELECT slug FROM waters WHERE {MEETS}")
def view_filter(spark, sf_dir):
    return waters(spark, sf_dir).where(filters.in_view(VIEW)).select("slug")


@query(WITH + f"SELECT slug FROM waters WHERE slug = 'w-77' OR association_id = 'a-13' OR ({LOD} AND {MEETS})")
def view_cull_pins(spark, sf_dir):
    w = waters(spark, sf_dir)
    return filters.cull(w, 7, VIEW, filters.pin_set(w, "w-77", "a-13")).select("slug")


@query(WITH + """SELECT slug, CASE WHEN ord % 9 = 0 THEN 'geometry' WHEN min_lon IS NOT NULL THEN 'bbox_fallback' ELSE 'hidden' END AS place,
  round(CASE WHEN ord % 9 = 0 OR min_lon IS NOT NULL THEN lon ELSE 25.0 END, 6) AS at_lon, round(CASE WHEN ord % 9 = 0 OR min_lon IS NOT NULL THEN lat ELSE 45.8 END, 6) AS at_lat FROM waters""")
def feature_place(spark, sf_dir):
    p = filters.feature_place(F.col("lon"), F.col("lat"), F.col("ord") % 9 == 0)
    return waters(spark, sf_dir).select("slug", p.alias("p")).select("slug", F.col("p.kind").alias("place"), F.round("p.lon", 6).alias("at_lon"), F.round("p.lat", 6).alias("at_lat"))


@query(WITH + "SELECT slug FROM waters WHERE sector_start IS NOT NULL AND sector_start < sector_end AND sector_end <= 1 AND sector_start >= 0")
def explicit_interval(spark, sf_dir):
    return waters(spark, sf_dir).where(filters.explicit_interval(F.col("sector_start"), F.col("sector_end"))).select("slug")


@query(WITH + "SELECT slug, kind FROM waters WHERE (kind = 'river' AND coalesce(length_km, 0) >= 30) OR (kind = 'lake' AND coalesce(area_ha, 0) >= 100)")
def majors_subset(spark, sf_dir):
    return filters.majors(waters(spark, sf_dir)).select("slug", "kind")


@query(WITH + """SELECT slug FROM waters WHERE ord % 3 = 0 OR (ord % 3 = 1 AND ord % 2 = 0 AND ord % 5 NOT IN (1, 2))""")
def eligible_sectors(spark, sf_dir):
    k = F.col("ord")
    status = F.when(k % 3 == 0, "resolved").when(k % 3 == 1, "review").otherwise("unresolved")
    reasons = F.when(k % 5 == 1, F.array(F.lit("far"), F.lit("invariant:order"))).when(k % 5 == 2, F.array(F.lit("no_course"))).when(k % 5 == 3, F.array(F.lit("far")))
    return waters(spark, sf_dir).where(filters.eligible(status, k % 2 == 0, reasons)).select("slug")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'interzis' WHEN p_size > 10 THEN 'dimensiune' WHEN p_partkey % 4 = 1 THEN 'permis' ELSE 'neconfirmat' END AS rule FROM part""")
def retention_rule(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") > 10, F.concat(F.col("p_size").cast("string"), F.lit(" cm")))
    stated = F.when(F.col("p_partkey") % 4 == 0, "Interzis").when(F.col("p_partkey") % 4 == 1, "permis")
    return p.select("p_partkey", filters.retention(size, stated).alias("rule"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0")
def publish_gate(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(filters.published(k % 2 == 0, F.when(k % 3 == 0, "approved").otherwise("draft"), F.lit(1))).select("s_suppkey")


RULES_SQL = """SELECT slug, 'has_length' AS rule FROM waters WHERE length_km IS NULL UNION ALL SELECT slug, 'balance' FROM waters WHERE NOT balance >= 0
 UNION ALL SELECT slug, 'locality' FROM waters WHERE locality IS NULL"""


@query(WITH + RULES_SQL)
def rule_violations(spark, sf_dir):
    return filters.violations(waters(spark, sf_dir), "slug", {"has_length": F.col("length_km").isNotNull(), "balance": F.col("balance") >= 0, "locality": F.col("locality").isNotNull()})


RANKED = """, ranked AS (SELECT *, count(*) OVER (PARTITION BY river_group) AS n_group, row_number() OVER (PARTITION BY river_group ORDER BY CASE WHEN lower(name) LIKE '%superior%' THEN 0 WHEN lower(name) LIKE '%mijloci%' THEN 1 WHEN lower(name) LIKE '%inferior%' THEN 2 ELSE 3 END, ord) AS i_rank FROM waters),
 placed AS (SELECT *, coalesce(course_frac, CASE WHEN n_group <= 1 THEN 0.5 ELSE CAST(i_rank - 1 AS DOUBLE) / (n_group - 1) END) AS f FROM ranked),
 cut AS (SELECT *, (lag(f) OVER w + f) / 2 AS lo, (lead(f) OVER w + f) / 2 AS hi FROM placed WINDOW w AS (PARTITION BY river_group ORDER BY f, i_rank)) """


@query(WITH + RANKED + """SELECT slug, round(f, 6) AS f, round(CASE WHEN sector_start IS NOT NULL THEN sector_start WHEN n_group <= 1 THEN 0 ELSE coalesce(lo, 0) END, 6) AS i_from,
 round(CASE WHEN sector_start IS NOT NULL THEN sector_end WHEN n_group <= 1 THEN 1 ELSE coalesce(hi, 1) END, 6) AS i_to FROM cut""")
def contract_intervals(spark, sf_dir):
    out = windows.contract_intervals(waters(spark, sf_dir), "river_group", "ord")
    return out.select("slug", F.round("f", 6).alias("f"), F.round("i_from", 6).alias("i_from"), F.round("i_to", 6).alias("i_to"))


CLICKS = "SELECT o_orderkey AS click, concat('g-', CAST(o_orderkey % 150 AS STRING)) AS river_group, CAST(o_orderkey * 13 % 997 AS DOUBLE) / 1000 + 0.00037 AS frac FROM orders"


@query(WITH + RANKED + f""", clicks AS ({CLICKS}), hit AS (
 SELECT c.click, c.frac, k.slug, k.ord, k.i_rank, CASE WHEN c.frac >= k.sector_start AND c.frac < k.sector_end THEN k.sector_end - k.sector_start END AS len,
  c.frac >= coalesce(k.lo, -1e9) AND c.frac < coalesce(k.hi, 1e9) AS owned FROM clicks c JOIN cut k ON c.river_group = k.river_group AND k.n_group > 1),
 stated AS (SELECT click, arg_min(slug, (len, ord)) AS slug FROM hit WHERE len IS NOT NULL GROUP BY click), owner AS (SELECT click, arg_min(slug, (i_rank, ord)) AS slug FROM hit WHERE owned GROUP BY click)
 SELECT c.click, coalesce(s.slug, o.slug) AS slug FROM clicks c LEFT JOIN stated s ON c.click = s.click LEFT JOIN owner o ON c.click = o.click""")
def contract_at_click(spark, sf_dir):
    clicks = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS click", "concat('g-', CAST(o_orderkey % 150 AS STRING)) AS river_group", "CAST(o_orderkey * 13 % 997 AS DOUBLE) / 1000 + 0.00037D AS frac")
    return windows.contract_at(clicks, waters(spark, sf_dir), "river_group", "ord").select("click", "slug")


@query(WITH + """, o AS (SELECT a.course, a.item AS a, b.item AS b, least(a.i_end, b.i_end) - greatest(a.i_start, b.i_start) AS overlap, least(a.i_end - a.i_start, b.i_end - b.i_start) AS shorter
 FROM contracts a JOIN contracts b ON a.course = b.course AND a.item < b.item) SELECT course, a, b, round(overlap, 6) AS overlap, round(overlap / shorter, 6) AS share FROM o WHERE overlap > 0.001""")
def interval_overlaps(spark, sf_dir):
    out = joins.interval_overlaps(contracts(spark, sf_dir), "course", "item", "i_start", "i_end", 0.001)
    return out.select("course", "a", "b", F.round("overlap", 6).alias("overlap"), F.round("share", 6).alias("share"))


@query(WITH + """, o AS (SELECT a.item AS a, b.item AS b, (least(a.i_end, b.i_end) - greatest(a.i_start, b.i_start)) / least(a.i_end - a.i_start, b.i_end - b.i_start) AS share
 FROM contracts a JOIN contracts b ON a.course = b.course AND a.item < b.item WHERE least(a.i_end, b.i_end) - greatest(a.i_start, b.i_start) > 0.001),
 m AS (SELECT item, max(share) AS worst FROM (SELECT a AS item, share FROM o UNION ALL SELECT b, share FROM o) GROUP BY item)
 SELECT c.item, CASE WHEN m.worst > 0.5 THEN 'review' ELSE 'resolved' END AS status, m.worst IS NOT NULL AS overlaps FROM contracts c LEFT JOIN m ON c.item = m.item""")
def demote_overlaps(spark, sf_dir):
    rows = contracts(spark, sf_dir).withColumn("status", F.lit("resolved"))
    return joins.demote_overlaps(rows, joins.interval_overlaps(rows, "course", "item", "i_start", "i_end", 0.001), "item").select("item", "status", "overlaps")


@query(WITH + """, w AS (SELECT course, item, i_end, lead(item) OVER v AS next_item, lead(i_start) OVER v AS next_start FROM contracts WINDOW v AS (PARTITION BY course ORDER BY i_start, item))
 SELECT course, item, next_item FROM w WHERE next_start < i_end""")
def adjacent_overlaps(spark, sf_dir):
    return windows.adjacent_overlaps(contracts(spark, sf_dir), "course", "item", "i_start", "i_end")


@query(WITH + """, p AS (SELECT o_orderkey AS course, CAST(o_custkey % 1000 AS DOUBLE) / 1000 AS frac FROM orders), h AS (SELECT p.course, p.frac, c.item, c.i_end - c.i_start AS len FROM p LEFT JOIN contracts c ON c.course = p.course AND p.frac >= c.i_start AND p.frac < c.i_end)
 SELECT course, frac, arg_min(item, (len, item)) AS item FROM h GROUP BY course, frac""")
def smallest_interval(spark, sf_dir):
    p = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS course", "CAST(o_custkey % 1000 AS DOUBLE) / 1000 AS frac")
    return joins.smallest_interval(p, contracts(spark, sf_dir), "course", "frac", "item", "i_start", "i_end")


@query(WITH + """, p AS (SELECT o_orderkey AS course, CAST(o_custkey % 1000 AS DOUBLE) / 1000 + 0.000123 AS frac FROM orders)
 SELECT p.course, p.frac, arg_min(c.item, (abs(c.i_start - p.frac), c.item)) AS item FROM p LEFT JOIN contracts c ON c.course = p.course GROUP BY p.course, p.frac""")
def nearest_on_line(spark, sf_dir):
    p = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS course", "CAST(o_custkey % 1000 AS DOUBLE) / 1000 + 0.000123D AS frac")
    return joins.nearest_value(p, contracts(spark, sf_dir), "course", "frac", "item", F.col("i_start"))


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS block FROM events""")
def as_of_block(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return joins.as_of(e, F.col("event_type") == "signup", F.col("event_id"), ["ts", "event_id"], ["user_id"], "block").select("event_id", "block")


@query("""WITH n AS (SELECT event_id, event_type, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 b AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN rn END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  first_value(CASE WHEN event_type = 'signup' THEN rn END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM n)
 SELECT event_id, CASE WHEN p IS NULL OR a - rn < rn - p THEN a WHEN a IS NULL OR rn - p < a - rn THEN p WHEN event_type = 'click' THEN a ELSE p END AS header FROM b""")
def nearest_header(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return joins.nearest_row(e, F.col("event_type") == "signup", "rn", ["rn"], ["user_id"], "header", F.col("event_type") == "click").select("event_id", "header")


@query(WITH + f""", s AS (SELECT s_suppkey, 20.26 + CAST(s_suppkey * 6151 % 9430 AS DOUBLE) / 1000 AS lon, 43.62 + CAST(s_suppkey * 32749 % 4650 AS DOUBLE) / 1000 AS lat FROM supplier),
 d AS (SELECT s_suppkey, slug, round(1000 * {km_sql('w.lat', 'w.lon', 's.lat', 's.lon')}, 0) AS m FROM s JOIN waters w ON abs(w.lat - s.lat) < 0.1 AND abs(w.lon - s.lon) < 0.2) SELECT s_suppkey, slug, m FROM d WHERE m <= 5000""")
def near_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "20.26D + CAST(s_suppkey * 6151 % 9430 AS DOUBLE) / 1000 AS lon", "43.62D + CAST(s_suppkey * 32749 % 4650 AS DOUBLE) / 1000 AS lat")
    # the limit holds for whole metres, so those of up to half a metre more are asked for
    near = joins.near_join(s, waters(spark, sf_dir), 5000.5, "s_suppkey", "slug", 0.1)
    return near.select("s_suppkey", "slug", F.round("m", 0).alias("m")).where("m <= 5000")


@query(WITH + """, b AS (SELECT * FROM waters WHERE min_lon IS NOT NULL) SELECT w.slug, b.slug AS other FROM waters w JOIN b ON w.min_lon <= b.max_lon AND b.min_lon <= w.max_lon AND w.min_lat <= b.max_lat AND b.min_lat <= w.max_lat""")
def boxes_meet(spark, sf_dir):
    w = waters(spark, sf_dir)
    return joins.boxes_meet(w, w.withColumnRenamed("slug", "other"), "slug", "other", 0.25)


@query(WITH + """, s AS (SELECT s_suppkey, 20.26 + CAST(s_suppkey * 6151 % 9430 AS DOUBLE) / 1000 AS lon, 43.62 + CAST(s_suppkey * 32749 % 4650 AS DOUBLE) / 1000 AS lat FROM supplier),
 b AS (SELECT judet, min(lon) + 2 AS x0, max(lon) - 3 AS x1, min(lat) + 1 AS y0, max(lat) - 1.5 AS y1 FROM waters GROUP BY judet),
 h AS (SELECT s_suppkey % 10 AS grp, judet, count(*) AS n FROM s JOIN b ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY ALL) SELECT grp, arg_max(judet, (n, judet)) AS judet, max(n) AS n FROM h GROUP BY grp""")
def spatial_majority(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "20.26D + CAST(s_suppkey * 6151 % 9430 AS DOUBLE) / 1000 AS lon", "43.62D + CAST(s_suppkey * 32749 % 4650 AS DOUBLE) / 1000 AS lat")
    b = waters(spark, sf_dir).groupBy("judet").agg((F.min("lon") + 2).alias("min_lon"), (F.max("lon") - 3).alias("max_lon"), (F.min("lat") + 1).alias("min_lat"), (F.max("lat") - 1.5).alias("max_lat"))
    hits = joins.points_in_boxes(s, b, "s_suppkey", "judet", 1.0).withColumn("grp", F.col("s_suppkey") % 10)
    return joins.spatial_majority(hits, "grp", "judet")


@query(f"""WITH p AS (SELECT user_id, event_id, ts, 20.26 + CAST(event_id * 7919 % 9430 AS DOUBLE) / 1000 AS lon, 43.62 + CAST(event_id * 104729 % 4650 AS DOUBLE) / 1000 AS lat FROM events),
 s AS (SELECT *, coalesce(1000 * {km_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT event_id, round(step, 2) AS step_m, round(sum(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 1) AS m FROM s""")
def cumulative_measure(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "20.26D + CAST(event_id * 7919 % 9430 AS DOUBLE) / 1000 AS lon", "43.62D + CAST(event_id * 104729 % 4650 AS DOUBLE) / 1000 AS lat")
    return windows.cumulative_measure(p, "user_id", "event_id").select("event_id", F.round("step_m", 2).alias("step_m"), F.round("m", 1).alias("m"))


@query(f"""WITH p AS (SELECT user_id, event_id, event_type, 20.26 + CAST(event_id * 7919 % 9430 AS DOUBLE) / 1000 AS lon, 43.62 + CAST(event_id * 104729 % 4650 AS DOUBLE) / 1000 AS lat FROM events),
 s AS (SELECT user_id, {km_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM p WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)) SELECT user_id, round(1000 * coalesce(max(step), 0), 1) AS max_edge_m FROM s GROUP BY user_id""")
def max_edge(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "20.26D + CAST(event_id * 7919 % 9430 AS DOUBLE) / 1000 AS lon", "43.62D + CAST(event_id * 104729 % 4650 AS DOUBLE) / 1000 AS lat")
    return windows.max_edge(p, "user_id", "event_type", "event_id").select("user_id", F.round("max_edge_m", 1).alias("max_edge_m"))


@query("""WITH f AS (SELECT user_id, event_id, value, value > 20 AS f, lag(value > 20) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
 i AS (SELECT *, sum(CAST(f AND NOT coalesce(p, false) AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f)
 SELECT user_id, CAST(island AS BIGINT) AS island, min(event_id) AS first, max(event_id) AS last, count(*) AS n, round(sum(value), 2) AS total FROM i WHERE f GROUP BY user_id, island""")
def uncovered_runs(spark, sf_dir):
    return windows.islands(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 20, F.round(F.sum("value"), 2).alias("total"))


@query("""WITH f AS (SELECT user_id, event_id, value, value > 10 AS f, lag(value > 10) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
 r AS (SELECT *, sum(CAST(f <> coalesce(p, NOT f) AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f), t AS (SELECT *, sum(value) OVER (PARTITION BY user_id, run) AS len FROM r)
 SELECT event_id FROM t WHERE NOT (f AND len >= 60)""")
def trim_near_runs(spark, sf_dir):
    return windows.trim_near_runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 10, "value", 60.0).select("event_id")


@query(WITH + """, b AS (SELECT *, max(i_end) OVER (PARTITION BY course ORDER BY i_start, i_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM contracts),
 g AS (SELECT *, sum(coalesce(CAST(i_start - e > 0.01 AS INT), 1)) OVER (PARTITION BY course ORDER BY i_start, i_end ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT course, min(i_start) AS i_start, max(i_end) AS i_end FROM g GROUP BY course, g""")
def coalesce_intervals(spark, sf_dir):
    return windows.coalesce_intervals(contracts(spark, sf_dir), ["course"], "i_start", "i_end", 0.01)


@query(WITH + """, r AS (SELECT river_group, slug, balance, lon, row_number() OVER w AS r, lead(balance) OVER w AS s, lead(lon) OVER w AS p FROM waters WINDOW w AS (PARTITION BY river_group ORDER BY balance DESC, lon, slug))
 SELECT river_group, slug, coalesce(round(balance - s, 9) < 500 AND abs(lon - p) > 2, false) AS ambiguous FROM r WHERE r = 1""")
def ambiguity_gap(spark, sf_dir):
    return windows.ambiguity(waters(spark, sf_dir), "river_group", "balance", "lon", "slug", 500.0, 2.0).select("river_group", "slug", "ambiguous")


@query("SELECT page_id, row_number() OVER (PARTITION BY h ORDER BY page_id) AS nth, count(*) OVER (PARTITION BY h) AS total FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS h FROM pages)")
def url_occurrences(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("h"))
    return windows.occurrences(p, "h", "page_id").select("page_id", "nth", "total")


@query(WITH + "SELECT slug, row_number() OVER (ORDER BY CAST(ord % 3 = 0 AS INT), CASE WHEN ord % 3 = 0 THEN length_km END DESC NULLS LAST, ord) AS z FROM waters")
def render_order(spark, sf_dir):
    return windows.render_positions(waters(spark, sf_dir), F.col("ord") % 3 == 0, "length_km", "ord").select("slug", "z")


@query(WITH + "SELECT slug, round(111412.84 * cos(radians(lat)) - 93.5 * cos(3 * radians(lat)) + 0.118 * cos(5 * radians(lat)), 3) AS m_lon, round(111132.92 - 559.82 * cos(2 * radians(lat)) + 1.175 * cos(4 * radians(lat)) - 0.0023 * cos(6 * radians(lat)), 3) AS m_lat FROM waters")
def metres_per_degree(spark, sf_dir):
    return waters(spark, sf_dir).select("slug", geo.metres_per_degree(F.col("lat")).alias("m")).select("slug", F.round("m.lon", 3).alias("m_lon"), F.round("m.lat", 3).alias("m_lat"))


@query(WITH + "SELECT judet, min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat FROM waters GROUP BY judet")
def bbox_union(spark, sf_dir):
    from torrentine.operators.aggregates import bbox_union as union

    return union(waters(spark, sf_dir), "judet")


@query(WITH + """, h AS (SELECT slug, unnest(range(CAST(floor(min_lon / 0.5) AS BIGINT), CAST(floor(max_lon / 0.5) AS BIGINT) + 1)) AS cx, min_lat, max_lat FROM waters WHERE min_lon IS NOT NULL)
 SELECT slug, cx, unnest(range(CAST(floor(min_lat / 0.5) AS BIGINT), CAST(floor(max_lat / 0.5) AS BIGINT) + 1)) AS cy FROM h""")
def cell_index(spark, sf_dir):
    from torrentine.operators.aggregates import cells

    return cells(waters(spark, sf_dir), "slug")


@query(WITH + "SELECT slug, concat('unc-', left(md5(name), 10)) AS id, sha256(concat(slug, chr(0), judet, chr(0), coalesce(locality, ''))) AS segment FROM waters")
def hash_identities(spark, sf_dir):
    return waters(spark, sf_dir).select("slug", identity.hash_slug("unc-", F.col("name")).alias("id"), identity.segment_id(F.col("slug"), F.col("judet"), F.col("locality")).alias("segment"))


@query("SELECT o_orderkey, epoch_us(TIMESTAMP '1998-08-01') - epoch_us(o_orderdate) >= 30 * 86400000000 AS stale FROM orders")
def stale_records(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.is_stale(F.col("o_orderdate"), F.lit("1998-08-01").cast("timestamp")).alias("stale"))


@query("""SELECT event_id, CASE WHEN event_id % 31 + 1 <= CASE event_id % 12 + 1 WHEN 2 THEN 28 WHEN 4 THEN 30 WHEN 6 THEN 30 WHEN 9 THEN 30 WHEN 11 THEN 30 ELSE 31 END
 THEN concat('2023-', lpad(CAST(event_id % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(event_id % 31 + 1 AS STRING), 2, '0')) END AS day FROM events""")
def iso_dates(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", identity.iso_date(e % 31 + 1, e % 12 + 1, F.lit(2023)).alias("day"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([A-Za-z]+://)[^/@]*@', '\\1') AS clean, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' END AS refused FROM pages""")
def url_policy(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_url(F.col("url")).alias("clean"), text.url_policy(F.col("url")).alias("refused"))
