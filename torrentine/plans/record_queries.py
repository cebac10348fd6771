"""Queries of the record pipeline: keyed and fuzzy joins, aggregates, deduplication, audits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from torrentine.functions import text
from torrentine.operators import aggregates, filters, joins, windows
from torrentine.plans.fixtures import WITH, table, waters
from torrentine.plans.registry import query
from torrentine.sources import sinks


@query("""SELECT n_nationkey, n_name, coalesce(list_sort(list(s_suppkey) FILTER (s_suppkey IS NOT NULL)), []) AS members FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL""")
def group_children(spark, sf_dir):
    out = joins.group_children(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), "n_nationkey", "s_nationkey", "s_suppkey", ["s_suppkey"], "members")
    return out.select("n_nationkey", "n_name", F.transform("members", lambda m: m["s_suppkey"]).alias("members"))


@query(WITH + "SELECT c.o_orderkey, w.slug, w.kind FROM (SELECT o_orderkey, concat('w-', CAST(o_custkey AS STRING)) AS slug FROM orders) c JOIN waters w ON c.slug = w.slug")
def lookup_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('w-', CAST(o_custkey AS STRING)) AS slug")
    return joins.lookup(o, waters(spark, sf_dir)).select("o_orderkey", "slug", "kind")


@query(WITH + """, pools AS (SELECT slug, kind, 0 AS pool FROM waters WHERE ord % 3 = 0 UNION ALL SELECT slug, judet, 1 FROM waters WHERE ord % 2 = 0 UNION ALL SELECT slug, name, 2 FROM waters)
 SELECT slug, min(pool) AS pool, arg_min(kind, pool) AS label FROM pools GROUP BY slug""")
def first_match_pools(spark, sf_dir):
    w = waters(spark, sf_dir)
    pools = [w.where("ord % 3 = 0").select("slug", F.col("kind").alias("label")), w.where("ord % 2 = 0").select("slug", F.col("judet").alias("label")), w.select("slug", F.col("name").alias("label"))]
    return joins.first_match(pools, "slug")


@query("""SELECT a.o_orderkey, a.o_custkey, list_filter([CASE WHEN a.o_totalprice <> b.p2 THEN 'price' END, CASE WHEN a.o_orderstatus <> b.s2 THEN 'status' END], lambda x: x IS NOT NULL) AS failed
 FROM orders a JOIN (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p2, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS s2 FROM orders WHERE o_orderkey % 5 <> 0) b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey""")
def checked_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    b = o.where("o_orderkey % 5 <> 0").selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p2", "CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS s2")
    return joins.checked_join(o, b, ["o_orderkey", "o_custkey"], {"price": ("o_totalprice", "p2"), "status": ("o_orderstatus", "s2")}).select("o_orderkey", "o_custkey", "failed")


@query("""WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 <> 0),
 s AS (SELECT k, arg_min(price, o) AS price FROM (SELECT o_orderkey // 2 * 2 AS k, o_totalprice * 2 AS price, o_orderkey AS o FROM orders WHERE o_orderkey % 2 = 0) GROUP BY k)
 SELECT coalesce(p.k, s.k) AS k, CASE WHEN p.k IS NULL OR (s.k IS NOT NULL AND p.price IS NULL) THEN s.price ELSE p.price END AS price, CASE WHEN p.k IS NULL THEN 'inserted' WHEN s.k IS NOT NULL AND p.price IS NULL THEN 'upgraded' ELSE 'kept' END AS change FROM p FULL JOIN s ON p.k = s.k""")
def merge_if_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price")
    s = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "o_totalprice * 2 AS price", "o_orderkey AS o")
    return joins.merge_if_missing(p, s, "k", "o", F.col("price").isNull(), ["price"])


@query(WITH + """, s AS (SELECT concat('s-', CAST(ord AS STRING)) AS sid, CASE WHEN ord % 3 = 0 THEN slug END AS slug, concat(name, CASE WHEN ord % 4 = 0 THEN ' x' ELSE '' END) AS name, judet FROM waters WHERE ord % 2 = 0),
 h AS (SELECT w.slug AS t, s.sid AS s, 0 AS r FROM waters w JOIN s ON w.slug = s.slug UNION ALL SELECT w.slug, s.sid, 1 FROM waters w JOIN s ON w.name = s.name AND w.judet = s.judet),
 u AS (SELECT t, s, min(r) AS r FROM h GROUP BY t, s), g AS (SELECT t, count(*) AS n, min(r) AS best FROM u GROUP BY t)
 SELECT slug, coalesce(n, 0) AS n_hits, best, CASE WHEN n IS NULL THEN 'untraced' WHEN n > 1 THEN 'ambiguous' WHEN best > 0 THEN 'suspect' ELSE 'traced' END AS verdict FROM waters LEFT JOIN g ON slug = t""")
def source_trace(spark, sf_dir):
    w = waters(spark, sf_dir).select("slug", "name", "judet")
    s = waters(spark, sf_dir).where("ord % 2 = 0").selectExpr("concat('s-', CAST(ord AS STRING)) AS sid", "CASE WHEN ord % 3 = 0 THEN slug END AS s_slug", "concat(name, CASE WHEN ord % 4 = 0 THEN ' x' ELSE '' END) AS s_name", "judet AS s_judet")
    return joins.trace(w, s, [("slug", [("slug", "s_slug")]), ("name", [("name", "s_name"), ("judet", "s_judet")])], "slug", "sid")


@query("SELECT DISTINCT p_name FROM part WHERE p_size > 25 AND p_name NOT IN (SELECT p_name FROM part WHERE p_retailprice > 1090)")
def not_published(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return windows.unexpected(p.where("p_size > 25"), p.where("p_retailprice > 1090"), "p_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_mktsegment = 'MACHINERY'")
def not_covered(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.where("c_mktsegment = 'MACHINERY'").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(WITH + "SELECT slug FROM waters WHERE ord % 5 = 0 UNION SELECT slug FROM waters WHERE area_ha > 300 UNION SELECT concat('w-', CAST(o_custkey AS STRING)) FROM orders WHERE o_orderstatus = 'F'")
def covered_slugs(spark, sf_dir):
    w, o = waters(spark, sf_dir), table(spark, sf_dir, "orders")
    return w.where("ord % 5 = 0").select("slug").union(w.where("area_ha > 300").select("slug")).union(o.where("o_orderstatus = 'F'").selectExpr("concat('w-', CAST(o_custkey AS STRING))")).distinct()


TOK = "list_distinct(list_filter(string_split(lower(regexp_replace({}, '[.,\\n]', ' ', 'g')), ' '), lambda x: length(x) > 6))"


@query(f"""WITH l AS (SELECT item_id, {TOK.format('text')} AS lt FROM benchmark), r AS (SELECT doc_id, {TOK.format('text')} AS rt FROM documents),
 lx AS (SELECT item_id, len(lt) AS ln, unnest(lt) AS t FROM l), rx AS (SELECT doc_id, len(rt) AS rn, unnest(rt) AS t FROM r),
 p AS (SELECT item_id, doc_id, count(*) AS shared, count(*) / greatest(any_value(ln), any_value(rn)) AS score FROM lx JOIN rx USING (t) GROUP BY item_id, doc_id),
 b AS (SELECT item_id, arg_max(doc_id, (score, -doc_id)) AS doc_id, arg_max(shared, (score, -doc_id)) AS shared, max(score) AS score FROM p WHERE score >= 0.05 AND shared >= 2 GROUP BY item_id) SELECT item_id, doc_id, shared, round(score, 6) AS score FROM b""")
def token_overlap_join(spark, sf_dir):
    tok = F.filter(F.split(F.lower(F.regexp_replace("text", "[.,\\n]", " ")), " "), lambda x: F.length(x) > 6)
    out = joins.token_overlap_join(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", tok, tok, 0.05, 2)
    return out.select("item_id", "doc_id", "shared", F.round("score", 6).alias("score"))


@query(WITH + """, t AS (SELECT w.slug, c.slug AS m, 1 AS tier FROM waters w JOIN waters c ON w.name = c.name AND c.ord % 7 = 3 WHERE w.ord % 2 = 0 UNION ALL SELECT w.slug, c.slug, 2 FROM waters w JOIN waters c ON w.river_group = c.river_group AND c.ord % 7 = 4 WHERE w.ord % 2 = 0),
 g AS (SELECT slug, tier, min(m) AS m, count(*) AS n FROM t GROUP BY slug, tier), f AS (SELECT slug, min(tier) AS tier FROM g GROUP BY slug)
 SELECT w.slug, CASE WHEN g.n = 1 THEN g.m END AS match, g.tier, CASE WHEN g.n IS NULL THEN 'unmatched' WHEN g.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM waters w LEFT JOIN f ON w.slug = f.slug LEFT JOIN g ON g.slug = f.slug AND g.tier = f.tier WHERE w.ord % 2 = 0""")
def tiered_match(spark, sf_dir):
    w = waters(spark, sf_dir)
    left = w.where("ord % 2 = 0")
    one = joins.keyed_tier(left, "slug", "name", w.where("ord % 7 = 3").select(F.col("slug").alias("other"), F.col("name").alias("n2")), "other", "n2")
    two = joins.keyed_tier(left, "slug", "river_group", w.where("ord % 7 = 4").select(F.col("slug").alias("other"), F.col("river_group").alias("g2")), "other", "g2")
    return joins.tiered_match(left, "slug", [one, two])


@query(WITH + """, s AS (SELECT river_group, slug, round(0.6 * (ord % 11 / 10.0) + 0.2 * (ord % 3 / 2.0) + 0.2 * coalesce(course_frac, 0), 9) AS score FROM waters),
 r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nx FROM s WINDOW w AS (PARTITION BY river_group ORDER BY score DESC, slug)) SELECT river_group, slug, score, rank, rank = 1 AND coalesce(round(score - nx, 9) < 0.1, false) AS ambiguous FROM r WHERE rank <= 5""")
def candidate_scores(spark, sf_dir):
    k = F.col("ord")
    return joins.score_candidates(waters(spark, sf_dir), "river_group", "slug", (k % 11).cast("double") / 10, (k % 3).cast("double") / 2, F.coalesce("course_frac", F.lit(0.0)))


@query(WITH + """SELECT slug, CASE WHEN length_km < 0.6 * (ord % 60) AND (ord % 50 >= 0.8 * (ord % 60) OR ord % 50 >= 2 * length_km) THEN 'fallback' ELSE 'primary' END AS source FROM waters""")
def prefer_longer(spark, sf_dir):
    w = waters(spark, sf_dir).selectExpr("slug", "length_km", "CAST(ord % 60 AS DOUBLE) AS contract_km", "CAST(ord % 50 AS DOUBLE) AS fallback_km")
    return joins.prefer_longer(w).select("slug", "source")


@query(WITH + "SELECT river_group, coalesce(arg_min(slug, ord) FILTER (kind = 'lake'), arg_min(slug, ord)) AS owner FROM waters GROUP BY river_group")
def group_owner(spark, sf_dir):
    return joins.group_owner(waters(spark, sf_dir), "river_group", "slug", F.col("kind") == "lake", "ord")


@query("SELECT c_custkey AS id, 'customer.segment' AS source_path, c_mktsegment AS target FROM customer UNION ALL SELECT s_suppkey, 'supplier.name', s_name FROM supplier UNION ALL SELECT o_orderkey, 'orders.priority', o_orderpriority FROM orders")
def labelled_union(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return joins.labelled_union({
        "customer.segment": t("customer").selectExpr("c_custkey AS id", "c_mktsegment AS target"),
        "supplier.name": t("supplier").selectExpr("s_suppkey AS id", "s_name AS target"),
        "orders.priority": t("orders").selectExpr("o_orderkey AS id", "o_orderpriority AS target"),
    })


@query("""SELECT c_custkey, coalesce(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), []) AS history FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def repair_history(spark, sf_dir):
    r = table(spark, sf_dir, "customer").select("c_custkey")
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return joins.with_history(r, h, ["c_custkey"], "o_orderkey").select("c_custkey", F.transform("history", lambda x: x["o_orderkey"]).alias("history"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def count_by_key(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return aggregates.count_by(c, o, "c_custkey")


@query(WITH + "SELECT association_id, list_sort(list(DISTINCT judet)) AS counties FROM waters GROUP BY association_id")
def county_sets(spark, sf_dir):
    return aggregates.sorted_set(waters(spark, sf_dir), "association_id", "judet", "counties")


@query(WITH + "SELECT DISTINCT judet FROM waters WHERE judet IS NOT NULL")
def distinct_counties(spark, sf_dir):
    w = waters(spark, sf_dir)
    return aggregates.distinct_sorted([w.where("contracted"), w.where("not contracted")], "judet")


#: The fold of texts as SQL: letters without marks by the same table, loose marks away, lower case.
PLAIN_SQL = f"regexp_replace(translate(lower(translate({{0}}, '{text.LEGACY}', '{text.MODERN}')), '{text.MARKED}', '{text.PLAIN}'), '\\p{{{{M}}}}+', '', 'g')"


@query(f"SELECT key, arg_min(w, doc_id) AS w FROM (SELECT doc_id, w, {PLAIN_SQL.format('trim(w)')} AS key FROM (SELECT doc_id, string_split(string_split(text, ' ')[1], chr(10))[1] AS w FROM documents)) WHERE key <> '' GROUP BY key")
def first_spelling(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring_index(F.substring_index("text", " ", 1), "\n", 1).alias("w"))
    return aggregates.first_spelling(d, text.locality_key(F.col("w")), "w", "doc_id")


@query(WITH + "SELECT lower(locality) AS key, count(*) AS n FROM waters WHERE judet IN ('NATION_1', 'NATION_2') AND locality IS NOT NULL GROUP BY 1")
def locality_counts(spark, sf_dir):
    return aggregates.counts_where(waters(spark, sf_dir), text.locality_key(F.col("locality")), F.col("judet").isin("NATION_1", "NATION_2"))


@query(WITH + "SELECT judet, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM waters GROUP BY judet")
def county_centroids(spark, sf_dir):
    return aggregates.centroids(waters(spark, sf_dir), "judet", F.col("lon"), F.col("lat")).select("judet", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN '_overall' ELSE lang END AS lang, count(*) FILTER (quality = 1) AS resolved, count(*) AS total, round(100.0 * count(*) FILTER (quality = 1) / count(*), 2) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def coverage_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return aggregates.coverage_rollup(d, "lang", F.col("quality") == 1)


@query(WITH + "SELECT kind, judet, count(*) AS n, CAST(grouping(kind) * 2 + grouping(judet) AS BIGINT) AS level FROM waters GROUP BY GROUPING SETS ((kind), (judet), (kind, judet))")
def progress_sets(spark, sf_dir):
    return aggregates.progress(waters(spark, sf_dir), [["kind"], ["judet"], ["kind", "judet"]])


@query(WITH + "SELECT CASE WHEN length_km IS NULL THEN 'null' WHEN length_km < 10 THEN '<10' WHEN length_km < 30 THEN '<30' ELSE '>=30' END AS bucket, count(*) AS n FROM waters GROUP BY 1")
def length_histogram(spark, sf_dir):
    return aggregates.histogram(waters(spark, sf_dir), F.col("length_km"), [10.0, 30.0])


@query(WITH + "SELECT judet, count(*) FILTER (contracted) AS n_contracted, count(*) FILTER (min_lon IS NOT NULL) AS with_geometry, count(*) FILTER (min_lon IS NULL) AS missing, CASE WHEN count(*) FILTER (min_lon IS NULL) = 0 THEN 'complete' ELSE 'partial' END AS status FROM waters GROUP BY judet")
def county_cross_tab(spark, sf_dir):
    m = {"n_contracted": F.col("contracted"), "with_geometry": F.col("min_lon").isNotNull(), "missing": F.col("min_lon").isNull()}
    return aggregates.cross_tab(waters(spark, sf_dir), "judet", m, F.when(F.col("missing") == 0, "complete").otherwise("partial"))


@query(WITH + "SELECT count(*) AS n, round(sum(length_km), 3) AS km, round(sum(area_ha), 3) AS ha, count(*) FILTER (contracted) AS n_contracted, count(DISTINCT judet) AS counties FROM waters")
def validation_totals(spark, sf_dir):
    return aggregates.totals(waters(spark, sf_dir), {"km": F.col("length_km"), "ha": F.col("area_ha")}, {"n_contracted": F.col("contracted")}, {"counties": "judet"})


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c) SELECT source, lang, n FROM r WHERE rn = 1")
def majority_vote(spark, sf_dir):
    return aggregates.majority(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return aggregates.duplicates(table(spark, sf_dir, "part"), F.col("p_name"))


@query("""WITH d AS (SELECT c_nationkey AS k, count(*) + CAST(c_nationkey % 3 = 0 AS BIGINT) AS n FROM customer GROUP BY c_nationkey), a AS (SELECT s_nationkey AS k, count(*) AS n FROM customer JOIN supplier ON c_custkey = s_suppkey GROUP BY s_nationkey)
 SELECT coalesce(d.k, a.k) AS k, 'n' AS field, CAST(d.n AS STRING) AS declared, CAST(a.n AS STRING) AS actual FROM d FULL JOIN a ON d.k = a.k WHERE d.n IS DISTINCT FROM a.n""")
def drift_check(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    d = c.groupBy(F.col("c_nationkey").alias("k")).agg((F.count(F.lit(1)) + F.max((F.col("c_nationkey") % 3 == 0).cast("long"))).alias("n"))
    a = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return aggregates.drift(d, a, "k", ["n"])


@query(WITH + "SELECT name, slug FROM (SELECT name, slug, row_number() OVER (PARTITION BY name ORDER BY length_km DESC NULLS LAST, ord) AS rn FROM waters) WHERE rn = 1")
def keep_largest(spark, sf_dir):
    return aggregates.keep_largest(waters(spark, sf_dir), "name", "length_km", "ord").select("name", "slug")


@query(WITH + "SELECT ord, CASE WHEN rn = 1 THEN name ELSE concat(name, '-', CAST(rn AS STRING)) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY area_ha DESC NULLS LAST, ord) AS rn FROM waters)")
def suffix_duplicates(spark, sf_dir):
    return aggregates.suffix_duplicates(waters(spark, sf_dir), "name", "area_ha", "ord").select("ord", "name")


@query(WITH + "SELECT slug FROM (SELECT slug, row_number() OVER (PARTITION BY judet, round(lon, 0), round(lat, 0) ORDER BY ord) AS rn FROM waters) WHERE rn = 1")
def first_by_rounded(spark, sf_dir):
    return aggregates.first_by(waters(spark, sf_dir), [F.col("judet"), F.round("lon", 0), F.round("lat", 0)], "ord").select("slug")


@query("SELECT o_custkey, o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS names, count(DISTINCT CAST(o_totalprice > 250000 AS INT)) > 1 AS conflict FROM orders GROUP BY ALL")
def merge_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("names", F.array("o_orderpriority")).withColumn("big", (F.col("o_totalprice") > 250000).cast("int"))
    return aggregates.merge_sets(o, ["o_custkey", "o_orderstatus"], ["names"], "big")


@query(WITH + """, g AS (SELECT *, bool_and(coalesce(length_km > 5, false)) OVER (PARTITION BY river_group) AS every_ok FROM waters) SELECT slug, CASE WHEN every_ok THEN 'switch' WHEN coalesce(length_km > 5 AND NOT kind = 'river', false) THEN 'partial' ELSE 'blocked' END AS action FROM g""")
def group_switch(spark, sf_dir):
    return aggregates.group_switch(waters(spark, sf_dir), "river_group", F.col("length_km") > 5, F.col("kind") == "river").select("slug", "action")


@query(WITH + "SELECT river_group, min(kind) AS kind FROM waters GROUP BY river_group HAVING count(*) >= 2 AND bool_and(coalesce(balance > -500, false)) AND count(DISTINCT kind) = 1")
def switched_groups(spark, sf_dir):
    return aggregates.switched_groups(waters(spark, sf_dir), "river_group", F.col("balance") > -500, "kind")


@query(WITH + "SELECT name, judet, max(length_km) AS length_km FROM waters GROUP BY name, judet")
def longest_per_key(spark, sf_dir):
    return aggregates.longest(waters(spark, sf_dir), [F.col("name"), F.col("judet")], "length_km")


@query(WITH + "SELECT 'no_box' AS rule, 'violation' AS severity, slug AS key FROM waters WHERE min_lon IS NULL UNION ALL SELECT 'duplicate_name', 'finding', name FROM waters GROUP BY name HAVING count(*) > 1")
def audit_report(spark, sf_dir):
    w = waters(spark, sf_dir)
    return aggregates.report({"no_box": ("violation", w.where("min_lon IS NULL").select(F.col("slug").alias("key"))), "duplicate_name": ("finding", aggregates.duplicates(w, F.col("name")))})


@query("SELECT reason, count(*) AS n FROM (SELECT unnest([event_type, concat('u', CAST(user_id % 20 AS STRING))]) AS reason FROM events) GROUP BY reason ORDER BY n DESC, reason LIMIT 15")
def top_reasons(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return windows.top_reasons(e, F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"))))


@query(WITH + "SELECT river_group, arg_max(slug, (balance, CAST(kind = 'lake' AS INT), -ord)) AS slug FROM waters GROUP BY river_group")
def max_importance(spark, sf_dir):
    return windows.pick_best(waters(spark, sf_dir), "river_group", "slug", F.col("balance"), (F.col("kind") == "lake").cast("int"), -F.col("ord"))


@query("""WITH a AS (SELECT doc_id AS path, md5(text) AS sha256 FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END AS sha256 FROM documents WHERE doc_id % 3 <> 0)
 SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'new' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.sha256 IS DISTINCT FROM b.sha256""")
def manifest_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("sha256"))
    b = d.where("path % 3 <> 0").withColumn("sha256", F.when(F.col("path") % 5 == 0, "x").otherwise(F.col("sha256")))
    return windows.manifest_diff(d.where("path % 7 <> 0"), b)


@query(WITH + "SELECT slug, kind, length_km, CAST(NULL AS DOUBLE) AS area_ha FROM waters WHERE kind = 'river' UNION ALL SELECT slug, kind, NULL, area_ha FROM waters WHERE kind = 'lake'")
def bag_union(spark, sf_dir):
    w = waters(spark, sf_dir)
    return w.where("kind = 'river'").select("slug", "kind", "length_km").unionByName(w.where("kind = 'lake'").select("slug", "kind", "area_ha"), allowMissingColumns=True)


@query("SELECT o_orderkey, list_distinct([o_orderstatus, left(o_orderpriority, 1), o_orderstatus]) AS q, list_sort(list_intersect([o_orderstatus, '1', '2'], [left(o_orderpriority, 1), 'F'])) AS both FROM orders")
def ordered_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.left("o_orderpriority", F.lit(1))
    both = F.array_sort(F.array_intersect(F.array(F.col("o_orderstatus"), F.lit("1"), F.lit("2")), F.array(p, F.lit("F"))))
    q = windows.unique_in_order(F.col("o_orderstatus"), p, F.col("o_orderstatus"))
    return o.select("o_orderkey", F.array_sort(q).alias("q"), both.alias("both"))


@query(f"""SELECT doc_id, trim(regexp_replace(regexp_replace(p, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded, regexp_replace(regexp_replace(p, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
 FROM (SELECT doc_id, {PLAIN_SQL.format("coalesce(text, '')")} AS p FROM documents)""")
def folded_texts(spark, sf_dir):
    """Whole texts of every language, folded and as slugs."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"), text.slugify(F.col("text")).alias("slug"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CASE WHEN p_partkey % 2 = 0 THEN 'km' ELSE 'ha' END AS unit, p_size + 0.5 AS half FROM part")
def parse_sizes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " km").otherwise(" Ha"))
    half = text.contract_km(F.concat(F.lit("sector 12, "), F.col("p_size").cast("string"), F.lit(",5 km")))
    return p.select("p_partkey", text.parse_size(raw).alias("s"), half.alias("half")).select("p_partkey", "s.value", "s.unit", "half")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id FROM r WHERE rn = 1""")
def latest_upsert(spark, sf_dir):
    return sinks.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""WITH t AS (SELECT c_custkey AS k, 'premap' AS tier, 0 AS p FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'batch', 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'private', 2 FROM customer WHERE c_custkey % 3 = 0) SELECT k, arg_min(tier, p) AS tier FROM t GROUP BY k""")
def tiered_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return sinks.by_priority({"premap": c.where("k % 5 = 0"), "batch": c.where("k % 2 = 0"), "private": c.where("k % 3 = 0")}, "k", "tier")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'override' WHEN s_suppkey % 3 = 0 THEN 'known' ELSE s_name END AS url FROM supplier")
def overlay_precedence(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("url"))
    o, k = s.where("s_suppkey % 4 = 0").withColumn("url", F.lit("override")), s.where("s_suppkey % 3 = 0").withColumn("url", F.lit("known"))
    return sinks.overlay(s, "s_suppkey", "url", [o, k])


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'OLD' END) AS seg FROM customer")
def preserve_enrichment(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("seg"))
    return sinks.preserve(new, c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("OLD").alias("seg")), "c_custkey", ["seg"])


@query("""WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS b, row_number() OVER (ORDER BY doc_id DESC) AS n FROM documents) SELECT doc_id FROM r WHERE b <= 200000 AND n <= 120""")
def evict_to_budget(spark, sf_dir):
    from torrentine.streaming.stateful import keep_within_budget

    return keep_within_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 200000, 120).select("doc_id")


@query("SELECT user_id, event_id FROM events WHERE (user_id, event_id // 1000) IN (SELECT (user_id, max(event_id // 1000)) FROM events GROUP BY user_id)")
def latest_generation(spark, sf_dir):
    from torrentine.streaming.stateful import latest_generation

    e = table(spark, sf_dir, "events").withColumn("generation", F.expr("event_id div 1000"))
    return latest_generation(e, ["user_id"], "generation").select("user_id", "event_id")
