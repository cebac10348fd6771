"""Queries of the river network, its texts, geometry kernels and the stateful operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from torrentine.functions import geo, identity, kernels, limits, text
from torrentine.operators import network, sectors, windows
from torrentine.plans.fixtures import WITH, contracts, table, waters
from torrentine.plans.registry import query
from torrentine.sources import readers
from torrentine.sources.scratch import checkpointed
from torrentine.streaming import stateful

LINKS = "SELECT DISTINCT unnest([o_custkey, o_custkey, o_custkey + 1, o_custkey * 7 % 100 + 20000]) AS u, unnest([o_custkey + 1, o_custkey * 7 % 100 + 20000, o_custkey, o_custkey]) AS v FROM orders"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({LINKS}), r AS (SELECT u AS node, least(u, min(v)) AS low FROM e GROUP BY u UNION SELECT e.v, min(r.low) FROM r JOIN e ON r.node = e.u WHERE r.low < e.v GROUP BY e.v)
 SELECT node, min(low) AS component FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    """Components over the edges of every order: a long chain of consecutive keys with shortcuts."""
    return network.components(table(spark, sf_dir, "orders").select("o_custkey", F.explode(F.expr("array(o_custkey + 1, o_custkey * 7 % 100 + 20000)")).alias("v")), "o_custkey", "v")


#: Beginnings and ends of limits with what they are, by a customer's key; where a number stands for {n}.
OPENS = (("Izvoare", "SOURCE", None), ("Baraj B{n}", "DAM", None), ("coada lacului L{n}", "LAKE_UPSTREAM", None), ("aval lac L{n}", "LAKE_DOWNSTREAM", None), ("Pod DN {n} din loc. Avrig", "BRIDGE", "DN {n}"), ("aval de loc. Bran", "LOCALITY", None),
         ("Limita jud. HD", "COUNTY_LIMIT", None), ("cascada Bigăr", "WATERFALL", None), ("Cetatea", "LOCALITY", None), ("DN 67 D Baia", "ROAD", "DN 67D"), ("pod CFR de fier la Avrig", "BRIDGE", "CFR"), ("drum forestier Valea Rea", "ROAD", None))
CLOSES = (("conf. râul Apa {n}", "CONFLUENCE", "Apa {n}"), ("vărsare", "MOUTH", None), ("vărsare în lacul Colibița", "LAKE_UPSTREAM", "Colibița"), ("Gherla", "LOCALITY", "Gherla"), ("granița cu Ucraina", "BORDER", "Ucraina"), ("ieșire din județ", "COUNTY_LIMIT", None),
          ("amonte lac Izvorul", "LAKE_UPSTREAM", "Izvorul"), ("podul Stefan din loc. Slatina", "BRIDGE", "Stefan"), ("Valea Fetii", "CONFLUENCE", "Valea Fetii"), ("conf. cu valea Braia (sat Braia) și toți afluenții", "CONFLUENCE", "valea Braia"), ("baraj B{n}", "DAM", "B{n}"))
JOINTS = (" – ", " - ", "- ", " –", " până la ")


def _picked(options, i: int | None, by: str) -> str:
    """CASE over a key for one column of the options."""
    quote = lambda x: "NULL" if x is None else "'" + x + "'" if "{n}" not in x else "concat('" + x.replace("{n}", "', CAST(c_custkey AS STRING), '") + "')"
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {quote(o if i is None else o[i])}" for k, o in enumerate(options)) + " END"


BY = (f"c_custkey % {len(OPENS)}", f"(c_custkey * 7 + 3) % {len(CLOSES)}", f"(c_custkey * 13 + c_acctbal_cents) % {len(JOINTS)}")
KEYED = "(SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) + 100000 AS c_acctbal_cents FROM customer)"


@query(f"""SELECT c_custkey, {_picked(OPENS, 1, BY[0])} AS from_kind, {_picked(OPENS, 2, BY[0])} AS road, {_picked(CLOSES, 1, BY[1])} AS to_kind, {_picked(CLOSES, 2, BY[1])} AS target, {BY[1]} = 9 AS tributaries FROM {KEYED}""")
def parsed_intervals(spark, sf_dir):
    """Limits of all pairs of beginnings and ends with five separators, 660 forms."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CAST(round(c_acctbal * 100) AS BIGINT) + 100000").alias("c_acctbal_cents"))
    text_ = F.concat(F.expr(_picked(OPENS, 0, BY[0])), F.expr(_picked(JOINTS, None, BY[2])), F.expr(_picked(CLOSES, 0, BY[1])))
    p = c.select("c_custkey", limits.parse_limits(text_).alias("p"))
    return p.select("c_custkey", F.col("p.from.kind").alias("from_kind"), F.col("p.from.road_ref").alias("road"), F.col("p.to.kind").alias("to_kind"), F.col("p.to.target").alias("target"), F.col("p.includes_tributaries").alias("tributaries"))


def event_points(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "user_id * 100000 + event_id % 400 AS node", "20.26D + CAST((event_id % 400) * 7919 % 9430 AS DOUBLE) / 1000 AS lon", "43.62D + CAST((event_id % 400) * 104729 % 4650 AS DOUBLE) / 1000 AS lat")
    return e.withColumn("way_id", F.col("user_id") * 100 + F.expr("event_id div 1000"))


def event_ways(spark, sf_dir):
    """A way holds all events of its number, of whichever users: numbers of several users meet from 100 000 events on."""
    packed = event_points(spark, sf_dir).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "node", "lon", "lat"))).alias("p"))
    point = F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    return packed.select("way_id", F.transform("p", lambda x: x["node"]).alias("nodes"), point.alias("part"))


@query("""WITH w AS (SELECT user_id * 100 + event_id // 1000 AS way_id, user_id * 100000 + event_id % 400 AS node, row_number() OVER (PARTITION BY user_id * 100 + event_id // 1000 ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id * 100 + event_id // 1000) AS k FROM events),
 j AS (SELECT node FROM w GROUP BY node HAVING count(DISTINCT way_id) >= 2), c AS (SELECT * FROM w WHERE k >= 2 AND (pos = 0 OR pos = k - 1 OR node IN (SELECT node FROM j))),
 n AS (SELECT way_id, node AS u, lead(node) OVER o AS v, row_number() OVER o - 1 AS seq FROM c WINDOW o AS (PARTITION BY way_id ORDER BY pos)) SELECT way_id, CAST(seq AS INT) AS seq, u, v FROM n WHERE v IS NOT NULL""")
def flow_edges(spark, sf_dir):
    return network.flow_edges(event_ways(spark, sf_dir)).select("way_id", "seq", "u", "v")


@query()
def river_courses(spark, sf_dir):
    edges = network.flow_edges(event_ways(spark, sf_dir)).withColumn("user_id", F.expr("way_id div 100"))
    return network.build_courses(edges, "user_id").select("group_key", "course_id", F.round("length_m", 1).alias("length_m"), F.size("keys").alias("n_edges"), F.size("synthetic").alias("n_gaps"), "qa")


@query("""WITH r AS (SELECT s_suppkey AS id, concat('I-', CAST(s_suppkey % 5 + 1 AS STRING), '-', CAST(s_suppkey % 4 AS STRING), '-', CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 3 END AS STRING)) AS code FROM supplier),
 d AS (SELECT DISTINCT code FROM r), u AS (SELECT code, CASE WHEN code LIKE '%-0-0' THEN regexp_replace(code, '-[1-9]-0-0$', '-0-0-0') WHEN code LIKE '%-0' THEN regexp_replace(code, '-[1-9]-0$', '-0-0') ELSE regexp_replace(code, '-[1-9]$', '-0') END AS up FROM d)
 SELECT u.code, p.code AS parent FROM u LEFT JOIN d p ON u.up = p.code""")
def cadastre_parents(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("concat('I-', CAST(s_suppkey % 5 + 1 AS STRING), '-', CAST(s_suppkey % 4 AS STRING), '-', CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 3 END AS STRING)) AS code").distinct()
    return network.cadastre_parents(s, "code")


LIMIT = """CASE c_custkey % 8 WHEN 0 THEN concat('Izvoare – conf. râul Apa ', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('Baraj B', CAST(c_custkey AS STRING), ' - vărsare') WHEN 2 THEN 'Județul Alba' WHEN 3 THEN 'toată lungimea'
 WHEN 4 THEN '-' WHEN 5 THEN concat('Pod DN ', CAST(c_custkey % 90 AS STRING), ' din loc. Avrig - Limita jud. HD') WHEN 6 THEN 'Sebeș, Petrești, Lancrăm' ELSE 'xx 12 yy' END"""


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 2 THEN 'whole_county' WHEN 3 THEN 'whole_course' WHEN 4 THEN 'empty' WHEN 6 THEN 'locality_list' WHEN 7 THEN 'unparsed' ELSE 'interval' END AS scope,
 CASE c_custkey % 8 WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'DAM' WHEN 5 THEN 'BRIDGE' END AS from_kind, CASE c_custkey % 8 WHEN 0 THEN 'CONFLUENCE' WHEN 1 THEN 'MOUTH' WHEN 5 THEN 'COUNTY_LIMIT' END AS to_kind,
 CASE c_custkey % 8 WHEN 0 THEN concat('Apa ', CAST(c_custkey AS STRING)) WHEN 5 THEN 'Hunedoara' END AS to_target, CASE WHEN c_custkey % 8 = 5 THEN concat('DN ', CAST(c_custkey % 90 AS STRING)) END AS road FROM customer""")
def parsed_limits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", limits.parse_limits(F.expr(LIMIT)).alias("p"))
    return c.select("c_custkey", "p.scope", F.col("p.from.kind").alias("from_kind"), F.col("p.to.kind").alias("to_kind"), F.col("p.to.target").alias("to_target"), F.col("p.from.road_ref").alias("road"))


CLASS = """SELECT item, length_m, km_ratio, low, tribs, (km_ratio IS NULL OR (km_ratio <= 1.25 AND (tribs OR km_ratio >= 0.8))) AS hi, (km_ratio IS NULL OR (km_ratio <= 1.6 AND (tribs OR km_ratio >= 0.6))) AS ok FROM
 (SELECT item, round((i_end - i_start) * 10000, 1) AS length_m, CASE WHEN course % 7 <> 0 THEN round(round((i_end - i_start) * 10000, 1) / 1000, 3) END AS km_ratio, CASE WHEN course % 3 = 0 THEN 0.9 WHEN course % 3 = 1 THEN 0.7 ELSE 0.5 END AS low, course % 5 = 0 AS tribs FROM contracts)"""


@query(WITH + f"""SELECT item, CASE WHEN low >= 0.8 AND km_ratio IS NOT NULL AND hi THEN 'high' WHEN low >= 0.6 AND ok THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN (low >= 0.8 AND km_ratio IS NOT NULL AND hi) OR (low >= 0.6 AND ok) THEN 'resolved' ELSE 'review' END AS status FROM ({CLASS})""")
def classified_sectors(spark, sf_dir):
    c = contracts(spark, sf_dir)
    k = F.col("course")
    rows = c.select("item", k, F.round((F.col("i_end") - F.col("i_start")) * 10000, 1).alias("length_m"), F.when(k % 3 == 0, 0.9).when(k % 3 == 1, 0.7).otherwise(0.5).alias("low"), (k % 5 == 0).alias("includes_tributaries"), F.array().cast("array<string>").alias("reasons"))
    rows = rows.withColumn("km_ratio", F.when(k % 7 != 0, F.round(F.col("length_m") / 1000, 3)))
    return sectors.classify(rows).select("item", "confidence", "status")


@query(WITH + """, iv AS (SELECT course, item, i_start * 20000 AS a, i_end * 20000 AS b FROM contracts), g AS (SELECT o_orderkey AS id, CAST(o_custkey % 9 + 1 AS DOUBLE) * 1000 AS km, count(*) AS n, min(a) AS lo, max(b) AS hi, max(b - a) AS len, arg_max(a, (b - a, -a)) AS ba, arg_max(b, (b - a, -a)) AS bb FROM orders JOIN iv ON o_orderkey = course GROUP BY o_orderkey, o_custkey)
 SELECT id AS sector_id, round(CASE WHEN n > 1 AND abs(hi - lo - km) < abs(len - km) THEN lo ELSE ba END, 3) AS m_from, round(CASE WHEN n > 1 AND abs(hi - lo - km) < abs(len - km) THEN hi ELSE bb END, 3) AS m_to FROM g""")
def county_stretch(spark, sf_dir):
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sector_id", "o_orderkey AS course_id", "'x' AS county", "CAST(o_custkey % 9 + 1 AS DOUBLE) AS contract_km")
    iv = contracts(spark, sf_dir).selectExpr("course AS course_id", "'x' AS county", "i_start * 20000 AS m_from", "i_end * 20000 AS m_to")
    return sectors.whole_county(s, iv).select("sector_id", F.round("m_from", 3).alias("m_from"), F.round("m_to", 3).alias("m_to"))


@query(WITH + """, c AS (SELECT course AS sector_id, item, i_start * 20000 AS m, CASE WHEN l % 2 = 0 THEN 'from' ELSE 'to' END AS role, CASE WHEN l % 3 = 0 THEN 0.9 WHEN l % 3 = 1 THEN 0.85 ELSE 0.5 END AS conf FROM (SELECT *, length(item) + CAST(round(i_start * 1000) AS INT) AS l FROM contracts)),
 r AS (SELECT *, row_number() OVER w AS rank, lead(conf) OVER w AS nc, lead(m) OVER w AS nm FROM c WINDOW w AS (PARTITION BY sector_id, role ORDER BY conf DESC, m, item))
 SELECT sector_id, role, item AS anchor, rank, rank = 1 AND coalesce(round(conf - nc, 9) < 0.1 AND abs(m - nm) > 200, false) AS ambiguous FROM r""")
def ranked_endpoints(spark, sf_dir):
    c = contracts(spark, sf_dir).withColumn("l", F.length("item") + F.round(F.col("i_start") * 1000).cast("int"))
    c = c.select(F.col("course").alias("sector_id"), F.when(F.col("l") % 2 == 0, "from").otherwise("to").alias("role"), (F.col("i_start") * 20000).alias("m"), F.when(F.col("l") % 3 == 0, 0.9).when(F.col("l") % 3 == 1, 0.85).otherwise(0.5).alias("confidence"), F.lit("x").alias("method"), F.col("item").alias("anchor"))
    return sectors.ranked(c).select("sector_id", "role", "anchor", "rank", "ambiguous")


@query()
def resolved_sectors(spark, sf_dir):
    """Sectors from candidates of their two ends, over the contracts of each course."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sector_id", "CAST(o_custkey % 9 + 1 AS DOUBLE) AS contract_km", "o_orderkey % 5 = 0 AS includes_tributaries")
    c = contracts(spark, sf_dir)
    ends = [c.select(F.col("course").alias("sector_id"), F.lit(r).alias("role"), (F.col(x) * 20000).alias("m"), F.lit(0.9).alias("confidence"), F.lit("x").alias("method"), F.col("item").alias("anchor")) for r, x in (("from", "i_start"), ("to", "i_end"))]
    return sectors.resolve(o, ends[0].unionByName(ends[1])).select("sector_id", "length_m", "km_ratio", "status", "confidence", "reasons")


@query(WITH + "SELECT slug, CASE WHEN NOT contracted THEN 'uncontracted' WHEN ord % 8 = 0 THEN 'precut' WHEN sector_end > sector_start THEN 'explicit' WHEN count(DISTINCT kind) OVER (PARTITION BY river_group) = 1 THEN 'projection' ELSE 'unverified' END AS focus FROM waters")
def selection_focus(spark, sf_dir):
    w = waters(spark, sf_dir).withColumn("precut", F.col("ord") % 8 == 0).withColumn("geometry_hash", F.col("kind"))
    return sectors.focus(w).select("slug", "focus")


def user_lines(spark, sf_dir):
    p = event_points(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "lon", "lat"))).alias("p"))
    return p.select("user_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("part"))


@query()
def line_kernels(spark, sf_dir):
    """Polyline kernels over the track of each user."""
    d = user_lines(spark, sf_dir)
    m = kernels.locate_m_udf("part", F.lit(24.0), F.lit(45.0))
    d = d.select("user_id", "part", m.alias("m"), kernels.simplify_udf("part", F.lit(0.5)).alias("s"), kernels.substring_udf("part", F.lit(1000.0), F.lit(50000.0)).alias("sub"))
    return d.select("user_id", F.round("m", 1).alias("m"), F.size("s").alias("simplified"), F.round(geo.part_length_km(F.col("sub")), 3).alias("sub_km"), F.round(kernels.hausdorff_udf("sub", "sub"), 3).alias("self_distance"), F.round(kernels.fraction_udf(F.array("part"), F.lit(24.0), F.lit(45.0)), 6).alias("fraction"))


@query("""WITH p AS (SELECT user_id, event_id, 20.26 + CAST((event_id % 400) * 7919 % 9430 AS DOUBLE) / 1000 AS lon, 43.62 + CAST((event_id % 400) * 104729 % 4650 AS DOUBLE) / 1000 AS lat FROM events),
 s AS (SELECT user_id, lon, lat, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2))) + 0 * lag(lat) OVER w) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, round(coalesce(sum(step), 0), 3) AS km, count(*) AS n, min(lon) AS min_lon, max(lat) AS max_lat FROM s GROUP BY user_id""")
def line_measures(spark, sf_dir):
    d = user_lines(spark, sf_dir).select("user_id", "part", geo.extent(F.array("part")).alias("e"))
    return d.select("user_id", F.round(geo.part_length_km(F.col("part")), 3).alias("km"), F.size("part").cast("long").alias("n"), F.col("e.min_lon").alias("min_lon"), F.col("e.max_lat").alias("max_lat"))


@query(WITH + """, r AS (SELECT slug, lon, lat, lon > 22 AND lon <= 24.5 AND lat >= 44 AND lat < 46 AS inside FROM waters WHERE lon NOT IN (22, 24.5) AND lat NOT IN (44, 46)) SELECT slug, inside FROM r""")
def point_in_polygon(spark, sf_dir):
    box = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((22.0, 44.0), (24.5, 44.0), (24.5, 46.0), (22.0, 46.0))])
    w = waters(spark, sf_dir).where("lon not in (22, 24.5) and lat not in (44, 46)")
    return w.select("slug", geo.point_in_ring(F.col("lat"), F.col("lon"), box).alias("inside"))


@query()
def geodesics(spark, sf_dir):
    return waters(spark, sf_dir).select("slug", F.round(kernels.vincenty(F.lit(25.0), F.lit(45.0), "lon", "lat"), 3).alias("m"))


@query()
def geometry_hashes(spark, sf_dir):
    d = user_lines(spark, sf_dir)
    return d.select("user_id", identity.geometry_summary(F.lit("LineString"), F.array("part")).alias("g")).select("user_id", "g.sha256", "g.n")


@query()
def river_name_keys(spark, sf_dir):
    w = waters(spark, sf_dir)
    return w.select("slug", text.river_match_keys(F.col("name")).alias("keys"), text.stem_key(F.col("name")).alias("stem"), text.water_key(F.col("name")).alias("water_key"), text.is_main_course(F.col("name")).alias("main"))


@query()
def name_similarity(spark, sf_dir):
    w = waters(spark, sf_dir)
    other = F.lag("name").over(Window.partitionBy("river_group").orderBy("ord"))
    return w.withColumn("other", other).where("other is not null").select("slug", F.round(text.char_similarity("name", "other"), 6).alias("ratio"), text.token_overlap(F.lower("name"), F.lower("other")).alias("overlap"), text.first_token_ok(F.lower("name"), F.lower("other")).alias("first_ok"))


#: A key's events one after the other: live holds the times of those that passed and are still in the window.
LIMITER = """{name}(k, rn, id, live, passed, wait) AS (SELECT k, rn, id, [t], true, 0 FROM {events} WHERE rn = 1 UNION ALL
 SELECT k, rn, id, CASE WHEN len(kept) < {most} THEN list_append(kept, t) ELSE kept END, len(kept) < {most}, CASE WHEN len(kept) < {most} THEN 0 ELSE greatest(1, CAST(ceil(kept[1] + {window} - t) AS INTEGER)) END
 FROM (SELECT e.k, e.rn, e.id, e.t, list_filter(r.live, lambda x: x > e.t - {window}) AS kept FROM {name} r JOIN {events} e ON e.k = r.k AND e.rn = r.rn + 1))"""
EVENTS = "e AS (SELECT user_id AS k, event_id AS id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query(f"WITH RECURSIVE {EVENTS}, {LIMITER.format(name='r', events='e', most=3, window=86400.0)} SELECT k AS user_id, id AS event_id, passed AS allowed, wait AS retry_after FROM r")
def rate_limit(spark, sf_dir):
    return stateful.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86400.0, 3)


@query(f"""WITH RECURSIVE {EVENTS}, r(k, rn, id, done, outcome) AS (SELECT k, rn, id, CASE WHEN event_type <> 'error' THEN t END, CASE WHEN event_type <> 'error' THEN 'run' ELSE 'failed' END FROM e WHERE rn = 1 UNION ALL
 SELECT k, rn, id, CASE WHEN live THEN done WHEN event_type <> 'error' THEN t END, CASE WHEN live THEN 'cached' WHEN event_type <> 'error' THEN 'run' ELSE 'failed' END
 FROM (SELECT e.*, r.done, r.done IS NOT NULL AND e.t - r.done < 43200.0 AS live FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1)) SELECT k AS user_id, id AS event_id, outcome FROM r""")
def ttl_dedupe(spark, sf_dir):
    return stateful.ttl_deduped(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") != "error", 43200.0)


@query(f"""WITH RECURSIVE v AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1e6 AS t, concat_ws('|', user_id, props) AS digest, CASE WHEN length(trim(concat('report on ', event_type, ' ', props))) NOT BETWEEN 10 AND 2000 THEN 'invalid' WHEN event_id % 17 = 0 THEN 'bot' END AS state FROM events),
 d AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY t, id) AS rn FROM v WHERE state IS NULL),
 s(digest, rn, id, done, run) AS (SELECT digest, rn, id, t, true FROM d WHERE rn = 1 UNION ALL SELECT d.digest, d.rn, d.id, CASE WHEN d.t - s.done < 60.0 THEN s.done ELSE d.t END, NOT d.t - s.done < 60.0 FROM s JOIN d ON d.digest = s.digest AND d.rn = s.rn + 1),
 f AS (SELECT user_id AS k, id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS rn FROM v WHERE id IN (SELECT id FROM s WHERE run)), {LIMITER.format(name='r', events='f', most=5, window=600.0)}
 SELECT v.id AS event_id, coalesce(state, CASE WHEN passed THEN 'accepted' WHEN NOT passed THEN 'limited' END, 'duplicate') AS outcome FROM v LEFT JOIN r ON v.id = r.id""")
def report_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.concat(F.lit("report on "), F.col("event_type"), F.lit(" "), F.col("props")).alias("message"), F.when(F.col("event_id") % 17 == 0, "http://x").alias("website"), F.concat_ws("|", "user_id", "props").alias("digest"))
    return stateful.report_pipeline(e, "user_id", "ts", "event_id")


@query()
def page_titles(spark, sf_dir):
    """Label-keyed reading of pages, over all of them."""
    return readers.html_records(table(spark, sf_dir, "pages"), "html", {"phone": ["telefon", "tel"], "address": ["adresa"]}, ["page_id"])


@query(WITH + """, p AS (SELECT w.slug, b.slug AS cand, greatest(b.max_lon - b.min_lon, b.max_lat - b.min_lat) >= 0.003 AS big, greatest(0, least(w.max_lon, b.max_lon) - greatest(w.min_lon, b.min_lon)) * greatest(0, least(w.max_lat, b.max_lat) - greatest(w.min_lat, b.min_lat)) AS o,
 sqrt(pow(greatest(0, greatest(w.min_lon, b.min_lon) - least(w.max_lon, b.max_lon)), 2) + pow(greatest(0, greatest(w.min_lat, b.min_lat) - least(w.max_lat, b.max_lat)), 2)) * 111.0 AS gap, (b.max_lon - b.min_lon) * (b.max_lat - b.min_lat) AS ar
 FROM waters w JOIN waters b ON w.river_group = b.river_group AND w.slug <> b.slug WHERE w.min_lon IS NOT NULL AND b.min_lon IS NOT NULL) SELECT slug, arg_max(cand, (big, o > 0, o, -gap, ar, cand)) AS cand FROM p GROUP BY slug""")
def pick_by_box(spark, sf_dir):
    from torrentine.operators.repairs import BOX, pick_by_box

    w = waters(spark, sf_dir).where("min_lon is not null")
    b = w.select(F.col("slug").alias("cand"), F.col("river_group").alias("g"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    return pick_by_box(w.join(b, (F.col("river_group") == F.col("g")) & (F.col("slug") != F.col("cand"))), "slug", "cand")


@query(WITH + "SELECT river_group, arg_max(slug, (1000 * (ord % 4) + CASE WHEN kind = 'lake' THEN 100 ELSE 0 END + CASE WHEN contracted THEN 10 ELSE 0 END - (ord % 13), slug)) AS slug FROM waters WHERE ord % 4 > 0 GROUP BY river_group")
def pick_by_hits(spark, sf_dir):
    from torrentine.operators.repairs import pick_by_hits

    w = waters(spark, sf_dir).select("river_group", "slug", (F.col("ord") % 4).alias("hits"), (F.col("kind") == "lake").alias("is_lake"), F.col("contracted").alias("is_majority"), (F.col("ord") % 13).alias("seat_km"))
    return pick_by_hits(w, "river_group", "slug", True).select("river_group", "slug")


@query(WITH + "SELECT slug, CASE WHEN ord % 2 = 0 AND min_lon IS NOT NULL THEN 'clip' WHEN locality IS NOT NULL THEN 'geometry' ELSE 'text' END AS how FROM waters")
def assigned_localities(spark, sf_dir):
    from torrentine.operators.repairs import assign_locality

    w = waters(spark, sf_dir)
    clip = w.where("ord % 2 = 0 and min_lon is not null").select("slug", F.lit("c").alias("locality"))
    return assign_locality([("clip", clip), ("geometry", w.select("slug", "locality"))], w.select("slug", F.lit("t").alias("locality")), "slug").select("slug", "how")


@query(WITH + "SELECT a.slug, b.slug AS other FROM waters a JOIN waters b ON a.kind = b.kind AND a.judet = b.judet AND a.slug < b.slug WHERE greatest(0, least(a.max_lon, b.max_lon) - greatest(a.min_lon, b.min_lon)) * greatest(0, least(a.max_lat, b.max_lat) - greatest(a.min_lat, b.min_lat)) >= 0.1 * least((a.max_lon - a.min_lon) * (a.max_lat - a.min_lat), (b.max_lon - b.min_lon) * (b.max_lat - b.min_lat)) AND least((a.max_lon - a.min_lon) * (a.max_lat - a.min_lat), (b.max_lon - b.min_lon) * (b.max_lat - b.min_lat)) > 0")
def same_body(spark, sf_dir):
    from torrentine.operators.repairs import same_body

    return same_body(waters(spark, sf_dir).withColumn("name", F.col("kind")), "slug", least=0.1)


@query(WITH + "SELECT slug, CASE WHEN ord % 3 = 0 AND min_lon IS NOT NULL THEN 'present' WHEN ord % 3 = 0 AND locality IS NOT NULL THEN 'bbox' WHEN ord % 3 = 0 THEN 'hidden' WHEN contracted THEN 'source_missing' ELSE 'uncontracted' END AS region_class FROM waters")
def region_classes(spark, sf_dir):
    from torrentine.operators.repairs import region_class

    w = waters(spark, sf_dir).select("slug", (F.col("ord") % 3 == 0).alias("matched"), F.col("min_lon").isNotNull().alias("has_geometry"), F.col("locality").isNotNull().alias("has_box"), F.col("contracted").alias("in_source"))
    return region_class(w).select("slug", "region_class")


HEXAGON = ((1.0, 0.0), (0.5, 0.8), (-0.5, 0.8), (-1.0, 0.0), (-0.5, -0.8), (0.5, -0.8))
CORNERS = ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), CAST({HEXAGON[(i + 1) % 6][0]} AS DOUBLE), CAST({HEXAGON[(i + 1) % 6][1]} AS DOUBLE))" for i, (x, y) in enumerate(HEXAGON))


@query(WITH + f""", n AS (SELECT n_name, CAST(20.5 AS DOUBLE) + n_nationkey % 5 * CAST(2 AS DOUBLE) AS cx, CAST(44 AS DOUBLE) + (n_nationkey // 5) * CAST(0.9 AS DOUBLE) AS cy FROM nation),
 seg AS (SELECT n_name, cx + r * x1 AS x1, cy + r * y1 AS y1, cx + r * x2 AS x2, cy + r * y2 AS y2 FROM n, (VALUES (CAST(1.0 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) rings(r), (VALUES {CORNERS}) c(i, x1, y1, x2, y2)),
 hit AS (SELECT slug, n_name, count(*) AS n FROM waters JOIN seg ON (y1 > lat) <> (y2 > lat) AND lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2 GROUP BY slug, n_name) SELECT slug, min(n_name) AS area FROM hit WHERE n % 2 = 1 GROUP BY slug""")
def polygon_join(spark, sf_dir):
    """Waters in hexagonal counties with a hole, by exact rings."""
    from torrentine.operators.repairs import polygon_join

    ring = lambda r: F.array(*[F.struct((F.col("cx") + r * x).alias("lon"), (F.col("cy") + r * y).alias("lat")) for x, y in HEXAGON])
    n = table(spark, sf_dir, "nation").select("n_name", (20.5 + F.col("n_nationkey") % 5 * 2.0).alias("cx"), (44.0 + F.floor(F.col("n_nationkey") / 5) * 0.9).alias("cy"))
    areas = n.select(F.col("n_name").alias("area"), F.array(ring(1.0), ring(0.2)).alias("rings"), (F.col("cx") - 1).alias("min_lon"), (F.col("cx") + 1).alias("max_lon"), (F.col("cy") - 0.8).alias("min_lat"), (F.col("cy") + 0.8).alias("max_lat"))
    return polygon_join(waters(spark, sf_dir), areas, "slug", "area")


@query()
def lake_matches(spark, sf_dir):
    from torrentine.operators.repairs import match_lakes

    w = waters(spark, sf_dir).withColumn("name_key", text.fold(F.col("name")))
    lakes = w.select(F.col("slug").alias("lake"), "name_key", (F.col("lon") + 0.01).alias("lon"), "lat", (F.col("ord") % 9 == 0).alias("is_dam"), F.coalesce("area_ha", F.lit(0.0)).alias("area_ha"))
    return match_lakes(w, lakes, "slug", "lake")


@query()
def near_duplicate_lines(spark, sf_dir):
    from torrentine.operators.repairs import near_duplicates

    small = lambda p: F.struct((20.26 + F.col("user_id") % 300 * 0.03 + (p["lon"] - 20.26) / 500).alias("lon"), (44.0 + (p["lat"] - 43.62) / 500).alias("lat"))
    d = user_lines(spark, sf_dir).select("user_id", F.transform("part", small).alias("part")).withColumn("e", geo.extent(F.array("part")))
    d = checkpointed(d).select("user_id", "part", "e.*")  # read four times
    return near_duplicates(d, d.withColumnRenamed("user_id", "other_id"), "user_id", "other_id")
