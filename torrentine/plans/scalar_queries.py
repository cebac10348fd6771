"""Queries of scalars, indexes, caches and small rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from torrentine.functions import geo, identity, text
from torrentine.operators import filters, joins, network, sectors, windows
from torrentine.plans.fixtures import WITH, contracts, table, waters
from torrentine.plans.map_queries import km_sql
from torrentine.plans.registry import query
from torrentine.sources import readers, sinks


@query(WITH + "SELECT slug, CASE WHEN name LIKE 'Valea %' OR name LIKE 'Raul %' THEN 'river' ELSE 'other' END AS water_type, CASE WHEN name LIKE '%superior%' THEN 0 WHEN name LIKE '%mijloci%' THEN 1 WHEN name LIKE '%inferior%' THEN 2 ELSE 3 END AS course_rank, NOT name LIKE 'Valea %' AS main_course FROM waters")
def water_types(spark, sf_dir):
    n = F.col("name")
    return waters(spark, sf_dir).select("slug", text.water_type(n).alias("water_type"), text.course_rank(n).alias("course_rank"), text.is_main_course(n).alias("main_course"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS plausible FROM customer")
def phone_check(spark, sf_dir):
    k = F.col("c_custkey")
    digits = F.lpad(k.cast("string"), 7, "0")
    phone = F.when(k % 3 == 0, F.concat(F.lit("072 "), F.left(digits, F.lit(3)), F.lit("."), F.right(digits, F.lit(4)))).when(k % 3 == 1, digits)
    return table(spark, sf_dir, "customer").select("c_custkey", text.phone_plausible(phone).alias("plausible"))


@query("SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url END AS link FROM pages")
def safe_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_link(F.col("url")).alias("link"))


@query(WITH + f"SELECT slug, round({km_sql('45.0', '25.0', 'lat', 'lon')}, 3) AS km FROM waters")
def haversine(spark, sf_dir):
    return waters(spark, sf_dir).select("slug", F.round(geo.haversine_km(F.lit(45.0), F.lit(25.0), F.col("lat"), F.col("lon")), 3).alias("km"))


@query("SELECT p_partkey, CASE WHEN lower(string_split(p_name, ' ')[1]) = string_split(lower(p_name), ' ')[1] AND len(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'bolt', 'ring'])) > 0 THEN round(len(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'bolt', 'ring'])) / greatest(len(list_distinct(string_split(p_name, ' '))), 3), 6) ELSE 0.0 END AS overlap FROM part")
def token_overlap(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.token_overlap(F.col("p_name"), F.lit("red bolt ring")), 6).alias("overlap"))


@query(WITH + "SELECT lower(name) AS key, list_sort(list(DISTINCT slug)) AS values FROM waters WHERE length(name) > 3 GROUP BY 1")
def name_index(spark, sf_dir):
    return readers.name_index(waters(spark, sf_dir), F.lower("name"), "slug")


@query(WITH + "SELECT key, slug FROM (SELECT name AS key, slug, row_number() OVER (PARTITION BY name ORDER BY CAST(kind = 'lake' AS INT) DESC, ord) AS rn FROM waters WHERE length(name) > 3) WHERE rn = 1")
def best_geometry(spark, sf_dir):
    return readers.best_geometry(waters(spark, sf_dir), F.col("name"), F.col("kind") == "lake", "ord").select("key", "slug")


@query("SELECT user_id AS id, list(value ORDER BY ts, event_id) AS lons FROM events GROUP BY user_id")
def assembled_ways(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ways = e.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("refs"))
    nodes = e.select(F.col("event_id").alias("id"), F.col("value").alias("lon"), F.lit(45.0).alias("lat"))
    return readers.assemble_ways(ways, nodes).select("id", F.transform("part", lambda p: p["lon"]).alias("lons"))


@query(WITH + "SELECT course, item, round((sum(l) OVER w - l) / sum(l) OVER (PARTITION BY course), 6) AS f_from, round(sum(l) OVER w / sum(l) OVER (PARTITION BY course), 6) AS f_to FROM (SELECT course, item, i_end - i_start AS l FROM contracts) WINDOW w AS (PARTITION BY course ORDER BY item ROWS UNBOUNDED PRECEDING)")
def part_fractions(spark, sf_dir):
    c = contracts(spark, sf_dir).withColumn("l", F.col("i_end") - F.col("i_start"))
    return windows.part_fractions(c, "course", "item", "l").select("course", "item", F.round("f_from", 6).alias("f_from"), F.round("f_to", 6).alias("f_to"))


@query("SELECT o_orderkey, c_mktsegment AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0")
def cache_hits(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    cache = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("answer"))
    return readers.cached(q, cache, "k")[0].select("o_orderkey", "answer")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0")
def cache_misses(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    cache = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    return readers.cached(q, cache, "k")[1].select("o_orderkey")


@query("SELECT c_custkey AS k, c_custkey % 4 + count(o_orderkey) AS hit_count, greatest(DATE '1993-01-01', max(CAST(o_orderdate AS DATE))) AS last_accessed FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def cache_touch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_custkey % 4 AS hit_count", "DATE'1993-01-01' AS last_accessed")
    return sinks.touch(c, table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "CAST(o_orderdate AS DATE) AS at"), "k")


@query("SELECT s_suppkey AS raw_file_path, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS sha FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'new' FROM supplier WHERE s_suppkey % 50 = 0")
def provenance_log(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    new = s.where("s_suppkey % 3 = 0").selectExpr("s_suppkey AS raw_file_path", "'new' AS sha").unionByName(s.where("s_suppkey % 50 = 0").selectExpr("s_suppkey + 1000000 AS raw_file_path", "'new' AS sha"))
    return sinks.append_provenance(s.selectExpr("s_suppkey AS raw_file_path", "'old' AS sha"), new)


@query(WITH + "SELECT DISTINCT k AS key, slug FROM (SELECT unnest([name, river_group, name]) AS k, slug FROM waters) WHERE k <> ''")
def key_index(spark, sf_dir):
    return joins.key_index(waters(spark, sf_dir), "slug", F.array("name", "river_group"), F.array("name"))


@query(WITH + "SELECT slug, round(CASE WHEN d <= 1 THEN -0.02 * (1 - d) WHEN d <= 2 THEN 0.15 ELSE 0.3 END, 6) AS penalty FROM (SELECT slug, sqrt(pow(lon - 25.0, 2) + pow(lat - 45.5, 2)) AS d FROM waters)")
def county_penalties(spark, sf_dir):
    d = F.sqrt(F.pow(F.col("lon") - 25.0, 2) + F.pow(F.col("lat") - 45.5, 2))
    return waters(spark, sf_dir).select("slug", F.round(joins.county_penalty(d), 6).alias("penalty"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) >= DATE '1995-06-01' AS active, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def exception_expiry(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", identity.active_exception(F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft"), stamp, F.to_date(F.lit("1995-06-01"))).alias("active"), identity.snapshot_date(stamp).alias("day"))


@query(WITH + "SELECT slug FROM waters WHERE name IN (SELECT name FROM waters WHERE ord % 31 = 5) OR river_group IN (SELECT name FROM waters WHERE ord % 31 = 5)")
def candidate_subset(spark, sf_dir):
    w = waters(spark, sf_dir)
    return filters.candidates(w, F.array("name", "river_group"), w.where("ord % 31 = 5").select(F.col("name").alias("key"))).select("slug")


@query(WITH + "SELECT slug FROM waters w WHERE (name, judet) IN (SELECT (name, judet) FROM waters WHERE ord % 2 = 1) AND NOT EXISTS (SELECT 1 FROM waters c WHERE c.ord % 9 = 4 AND c.name = w.name AND c.length_km >= w.length_km)")
def fallback_rows(spark, sf_dir):
    w = waters(spark, sf_dir).withColumn("stem", F.col("name"))
    return filters.fallback_wanted(w, w.where("ord % 2 = 1"), w.where("ord % 9 = 4")).select("slug")


@query(WITH + "SELECT slug, ord % 5 IN (2, 4) OR ord % 3 = 0 AS wanted, CASE WHEN ord % 3 = 0 THEN 2 ELSE 1 END AS kept FROM waters")
def tag_filters(spark, sf_dir):
    k = F.col("ord")
    level = (k % 5).cast("string")
    tags = F.when(k % 3 == 0, F.create_map(F.lit("admin_level"), level, F.lit("water"), F.lit("lake"), F.lit("name:ro"), F.lit("x"))).otherwise(F.create_map(F.lit("admin_level"), level, F.lit("name:ro"), F.lit("x")))
    w = waters(spark, sf_dir).withColumn("tags", tags)
    return w.select("slug", filters.area_wanted(F.col("tags")).alias("wanted"), F.size(filters.keep_tags(F.col("tags"), ["water"], ["name:", "alt_name"])).alias("kept"))


@query(WITH + "SELECT course AS course_id, m FROM (SELECT DISTINCT course, unnest([i_start, i_end]) * 20000 AS m FROM contracts) WHERE m >= 1 AND m <= 15000 - 1")
def interval_crossings(spark, sf_dir):
    iv = contracts(spark, sf_dir).selectExpr("course AS course_id", "'x' AS county", "i_start * 20000 AS m_from", "i_end * 20000 AS m_to")
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS course_id", "15000.0D AS length_m")
    return sectors.crossings(iv, c).select("course_id", "m")


@query(WITH + "SELECT river_group AS sector_id, arg_min(ord, (CASE kind WHEN 'lake' THEN 1 WHEN 'river' THEN 2 ELSE 3 END, CASE WHEN contracted THEN 1 ELSE 3 END, ord)) AS try FROM waters GROUP BY river_group")
def best_attempt(spark, sf_dir):
    w = waters(spark, sf_dir).select(F.col("river_group").alias("sector_id"), F.col("ord").alias("try"), F.when(F.col("kind") == "lake", "resolved").when(F.col("kind") == "river", "review").otherwise("unresolved").alias("status"), F.when(F.col("contracted"), "high").otherwise("low").alias("confidence"))
    return sectors.best_of(w)


@query(WITH + "SELECT slug, CASE WHEN s >= 0.9 AND contracted THEN 'duplicate' WHEN kind = 'pond' AND s < 0.5 THEN 'tributary' WHEN s >= 0.5 THEN 'partial' WHEN kind = 'lake' AND s < 0.05 THEN 'collision' WHEN s > 0 THEN 'ambiguous' END AS class FROM (SELECT *, CAST(ord % 101 AS DOUBLE) / 100 AS s FROM waters)")
def overlap_classes(spark, sf_dir):
    c = sectors.overlap_class((F.col("ord") % 101).cast("double") / 100, F.col("contracted"), F.col("kind") == "lake", F.col("kind") == "pond")
    return waters(spark, sf_dir).select("slug", c.alias("class"))


@query(WITH + """, s AS (SELECT name, min(q) AS only_q FROM (SELECT name, CASE WHEN ord % 4 = 0 THEN concat('Q', CAST(ord % 12 AS STRING)) END AS q FROM waters) WHERE q IS NOT NULL GROUP BY name HAVING count(DISTINCT q) = 1)
 SELECT slug, coalesce(CASE WHEN ord % 4 = 0 THEN concat('Q', CAST(ord % 12 AS STRING)) END, s.only_q, w.name) AS grp FROM waters w LEFT JOIN s ON w.name = s.name""")
def merged_groups(spark, sf_dir):
    w = waters(spark, sf_dir).withColumn("wikidata", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("Q"), (F.col("ord") % 12).cast("string"))))
    return network.merge_partial(w, "name", "wikidata").select("slug", F.col("group").alias("grp"))


@query(WITH + "SELECT slug AS id, coalesce(locality, 'none') AS town, kind AS type FROM waters")
def frontend_rows(spark, sf_dir):
    return sinks.frontend(waters(spark, sf_dir), {"slug": "id", "locality": "town", "kind": "type"}, {"town": "none"}, "name")


@query(WITH + "SELECT concat('{\"type\":\"Feature\",\"properties\":{\"slug\":\"', slug, '\"},\"geometry\":null}') AS feature FROM waters WHERE contracted")
def feature_collection(spark, sf_dir):
    w = waters(spark, sf_dir).withColumn("g", F.lit(None).cast("string")).withColumn("_hidden", ~F.col("contracted"))
    return sinks.feature_collection(w, "g", ["slug"])


@query(WITH + "SELECT river_group, count(DISTINCT kind) AS n_kinds, count(*) FILTER (kind = 'lake') AS lakes FROM waters GROUP BY river_group")
def group_codes(spark, sf_dir):
    from torrentine.operators.aggregates import code_counts

    c = code_counts(waters(spark, sf_dir), "river_group", "kind")
    return c.select("river_group", F.size("codes").cast("long").alias("n_kinds"), F.coalesce(F.try_element_at("codes", F.lit("lake")), F.lit(0)).alias("lakes"))


@query(WITH + f"""SELECT s_suppkey, arg_min(slug, (m, slug)) AS slug, min(m) AS m FROM (SELECT s_suppkey, w.slug, round(1000 * {km_sql('w.lat', 'w.lon', 's.lat', 's.lon')}, 3) AS m FROM
 (SELECT s_suppkey, 20.26 + CAST(s_suppkey * 6151 % 9430 AS DOUBLE) / 1000 AS lon, 43.62 + CAST(s_suppkey * 32749 % 4650 AS DOUBLE) / 1000 AS lat FROM supplier) s JOIN waters w ON abs(w.lat - s.lat) < 0.2 AND abs(w.lon - s.lon) < 0.3) WHERE m <= 10000 GROUP BY s_suppkey""")
def nearest_place(spark, sf_dir):
    from torrentine.operators.repairs import nearest_within

    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "20.26D + CAST(s_suppkey * 6151 % 9430 AS DOUBLE) / 1000 AS lon", "43.62D + CAST(s_suppkey * 32749 % 4650 AS DOUBLE) / 1000 AS lat")
    return nearest_within(s, waters(spark, sf_dir), "s_suppkey", "slug", 10.0, 0.2)


@query(WITH + "SELECT slug, CASE WHEN ord % 3 = 0 THEN 'apa' ELSE river_group END AS grp, true AS same FROM waters")
def group_keys(spark, sf_dir):
    n, g = F.col("name"), F.when(F.col("ord") % 3 != 0, F.col("river_group")).otherwise("")
    return waters(spark, sf_dir).select("slug", text.group_key(g, n).alias("grp"), text.same_river(n, F.lit("Râul Apa (x)")).alias("same"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ajvps' WHEN 1 THEN 'romsilva' WHEN 2 THEN 'association' WHEN 3 THEN 'company' ELSE 'other' END AS kind FROM customer")
def association_types(spark, sf_dir):
    name = F.expr("concat(CASE c_custkey % 5 WHEN 0 THEN 'AJVPS ' WHEN 1 THEN 'Direcția Silvică ' WHEN 2 THEN 'Asociația ' WHEN 3 THEN 'Pescar SRL ' ELSE 'Primăria ' END, c_name)")
    return table(spark, sf_dir, "customer").select("c_custkey", text.association_type(name).alias("kind"))


@query("SELECT p_partkey, concat('A b-', p_name, ' (x), /y') AS clean, concat('````', chr(10), 'a```b', chr(10), '````') AS fenced, concat('\\*', replace(p_brand, '#', '\\#'), '\\#') AS inline FROM part")
def sanitized_texts(spark, sf_dir):
    dirty = F.concat(F.lit("A\u0007  b-<"), F.col("p_name"), F.lit("> \n(x),\t/y;"))
    return table(spark, sf_dir, "part").select("p_partkey", text.sanitize_name(dirty).alias("clean"), text.fence(F.lit("a```b")).alias("fenced"), text.escape_inline(F.concat(F.lit("*"), F.col("p_brand"), F.lit("#"))).alias("inline"))


@query(WITH + "SELECT slug, CASE ord % 4 WHEN 0 THEN 'source' WHEN 1 THEN concat('limit of county ', judet) WHEN 2 THEN concat('lake upstream ', name) ELSE 'bridge ?' END AS label FROM waters")
def evidence_labels(spark, sf_dir):
    k = F.col("ord") % 4
    kind = F.when(k == 0, "SOURCE").when(k == 1, "COUNTY_LIMIT").when(k == 2, "LAKE_UPSTREAM").otherwise("BRIDGE")
    return waters(spark, sf_dir).select("slug", text.evidence_label(kind, F.when(k == 2, F.col("name")), F.col("judet")).alias("label"))


@query("SELECT event_id, sha256(concat('[\"', CAST(user_id AS VARCHAR), '\",\"', event_type, '\",\"\"]')) AS digest FROM events")
def report_digests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", identity.report_digest(F.col("user_id"), F.col("event_type"), F.lit(None)).alias("digest"))


@query(WITH + """, b AS (SELECT slug, judet, min_lon, max_lon, min_lat, max_lat, lead(min_lon) OVER w AS n0, lead(max_lon) OVER w AS n1, lead(min_lat) OVER w AS n2, lead(max_lat) OVER w AS n3 FROM waters WHERE min_lon IS NOT NULL WINDOW w AS (PARTITION BY river_group ORDER BY ord))
 SELECT slug, abs((min_lon + max_lon) / 2 - (n0 + n1) / 2) <= 0.5 AND abs((min_lat + max_lat) / 2 - (n2 + n3) / 2) <= 0.5 AS agree FROM b WHERE n0 IS NOT NULL""")
def extent_agreement(spark, sf_dir):
    w = Window.partitionBy("river_group").orderBy("ord")
    corners = ("min_lon", "max_lon", "min_lat", "max_lat")
    rows = waters(spark, sf_dir).where("min_lon is not null").withColumns({f"n_{c}": F.lead(c).over(w) for c in corners}).where("n_min_lon is not null")
    return rows.select("slug", geo.extents_agree({c: F.col(c) for c in corners}, {c: F.col(f"n_{c}") for c in corners}, 0.5).alias("agree"))


@query(WITH + "SELECT slug, ord % 2 = 0 AND ord % 3 <> 0 AS precut FROM waters")
def precut_sectors(spark, sf_dir):
    one = F.struct(F.col("lon"), F.col("lat"))
    parts = F.when(F.col("ord") % 3 == 0, F.array(F.array(one))).otherwise(F.array(F.array(one), F.array(one, one)))
    return waters(spark, sf_dir).select("slug", filters.precut(F.when(F.col("ord") % 2 == 0, "sector").otherwise("course"), parts).alias("precut"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def covered_orders(spark, sf_dir):
    """Semi join: orders with a returned item."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query(WITH + "SELECT slug, list_sort(list_intersect(list_distinct([river_group, judet, kind]), ['g-3', 'g-7', 'NATION_4', 'lake', 'pond'])) AS shared FROM waters WHERE len(list_intersect([river_group, judet, kind], ['g-3', 'g-7', 'NATION_4', 'lake', 'pond'])) > 0")
def shared_keys(spark, sf_dir):
    wanted = F.array(*map(F.lit, ("g-3", "g-7", "NATION_4", "lake", "pond")))
    keys = F.array("river_group", "judet", "kind")
    return waters(spark, sf_dir).where(F.arrays_overlap(keys, wanted)).select("slug", F.array_sort(F.array_intersect(keys, wanted)).alias("shared"))


@query(WITH + "SELECT river_group, slug FROM (SELECT river_group, slug, row_number() OVER (PARTITION BY river_group ORDER BY kind = 'lake' DESC, sqrt(pow(lon - 25.0, 2) + pow(lat - 45.5, 2)), slug) AS rn FROM waters) WHERE rn = 1")
def best_per_group(spark, sf_dir):
    """The member of each group that is exact (a lake) and nearest to a centre."""
    d = F.sqrt(F.pow(F.col("lon") - 25.0, 2) + F.pow(F.col("lat") - 45.5, 2))
    return joins.best_by(waters(spark, sf_dir), "river_group", "slug", (F.col("kind") == "lake").desc(), d.asc(), F.col("slug").asc())


@query(WITH + """, c AS (SELECT river_group, slug AS cluster, lon AS c_lon, lat AS c_lat FROM waters WHERE kind = 'river'), p AS (SELECT w.slug, cluster, sqrt(pow(w.lon - c_lon, 2) + pow(w.lat - c_lat, 2)) AS d FROM waters w JOIN c ON w.river_group = c.river_group WHERE w.kind <> 'river'),
 s AS (SELECT slug, cluster, round(1 - CASE WHEN d <= 1 THEN -0.02 * (1 - d) WHEN d <= 2 THEN 0.15 ELSE 0.3 END, 9) AS score FROM p) SELECT slug, cluster, score FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, cluster) AS rn FROM s) WHERE rn = 1""")
def nearest_cluster(spark, sf_dir):
    w = waters(spark, sf_dir)
    clusters = w.where("kind = 'river'").select("river_group", F.col("slug").alias("cluster"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    d = F.sqrt(F.pow(F.col("lon") - F.col("c_lon"), 2) + F.pow(F.col("lat") - F.col("c_lat"), 2))
    return joins.pick_cluster(w.where("kind <> 'river'"), clusters, "slug", "cluster", "river_group", d)


@query("""SELECT l_orderkey * 10 + l_linenumber AS sector_id, 'to' AS role, min(CAST(o_custkey % 50 * 20 AS DOUBLE)) AS m, 0.75 AS confidence, 'cadastre_outlet' AS method, CAST(o_custkey AS VARCHAR) AS anchor
 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 7 * 100 <= 300 AND l_linenumber % 3 = o_custkey % 3 GROUP BY l_orderkey, l_linenumber, o_custkey""")
def cadastre_confluences(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS sector_id", "'to' AS role", "'CONFLUENCE' AS kind", "l_orderkey AS course_id", "array(concat('k', CAST(l_linenumber % 3 AS STRING)), 'none') AS keys")
    outlets = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS course_id", "concat('k', CAST(o_custkey % 3 AS STRING)) AS key", "CAST(o_custkey AS STRING) AS code", "CAST(o_custkey % 50 * 20 AS DOUBLE) AS m", "CAST(o_custkey % 7 * 100 AS DOUBLE) AS dist_m")
    return sectors.cadastre_outlets(e, outlets)
