"""Chains, networks, sectors, sources, sinks and stateful operators on small inputs."""

import random
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from torrentine.functions import kernels
from torrentine.operators import chains, filters, joins, network, sectors, windows
from torrentine.sources import readers, sinks
from torrentine.streaming import stateful


def test_longest_path_breaks_cycles_and_ties():
    edges = [(1, 2, "a", 5.0), (2, 3, "b", 5.0), (3, 2, "c", 1.0), (1, 3, "d", 20.0), (3, 4, "e", 1.0), (3, 5, "f", 1.0), (1, 2, "g", 4.0)]
    p = chains.longest_path(edges)
    assert p["nodes"] == [1, 3, 4] and p["keys"] == ["d", "e"] and p["notes"] == ["cycle_broken", "multiple_sinks"] and p["length"] == 21
    assert chains.longest_path([(1, 1, "x", 3.0)]) is None


def test_longest_path_is_longest():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(2, 7)
        edges = [(a, b, f"{a}-{b}", float(r.randint(1, 9))) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6]
        if not edges:
            continue
        def reach(x):
            return max((e[3] + reach(e[1]) for e in edges if e[0] == x), default=0.0)

        assert chains.longest_path(edges)["length"] == max(reach(x) for x in range(n))


def test_chains():
    a, b, c = np.array([[0.0, 0.0], [1.0, 0.0]]), np.array([[2.0, 0.0], [1.0, 0.0]]), np.array([[5.0, 5.0], [6.0, 5.0]])
    line, used = chains.grow([a, b, c], 0.01)
    assert line[:, 0].tolist() == [0, 1, 2] and used == [0, 1]
    assert chains.strict_chain([a, b, a[::-1]])[:, 0].tolist() == [0, 1, 2] and chains.strict_chain([a, b, c]) is None
    sq = [np.array(x, float) for x in ([[0, 0], [1, 0]], [[1, 1], [1, 0]], [[1, 1], [0, 1]], [[0, 0], [0, 1]])]
    assert chains.ring(sq)[[0, -1]].tolist() == [[0, 0], [0, 0]] and chains.ring(sq[:3]) is None
    assert chains.cluster([a, c, b, np.array([[4.97, 5.0], [1.03, 0.0]])], 0.06) == [[0, 2, 3], [1]]
    assert chains.orient(b, first=(1, 0))[0, 0] == 1 and chains.orient(np.array([[0.0, 0.0], [0.0, 1.0]]))[0, 1] == 1
    near = [((0.0, 0.0), (0.0, 0.01)), ((0.0, 0.011), (0.0, 0.02)), ((0.0, 0.05), (0.0, 0.06))]
    assert [[i for i, _, _ in c] for c in chains.chain_gaps(near)] == [[0, 1], [2]]
    assert [[i for i, _, _ in c] for c in chains.chain_gaps(near, shares=lambda p, q: True)] == [[0, 1, 2]]
    assert chains.main_stem([(1, 2, "a", 1.0), (2, 3, "b", 1.0), (2, 4, "c", 5.0), (4, 5, "d", 1.0)]) in ([1, 2, 4, 5], [3, 2, 4, 5])
    line, spans = chains.assemble([a, c], ["", "gap_bridge"])
    assert len(line) == 4 and spans[0]["kind"] == "gap_bridge" and spans[0]["m_to"] > spans[0]["m_from"]


def part(*pts):
    return [{"lon": float(x), "lat": float(y)} for x, y in pts]


WAYS = "way_id long, nodes array<long>, part array<struct<lon:double,lat:double>>, river string"


def test_network(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3], part((0, 0), (0, -0.01), (0, -0.02)), "olt"), (2, [9, 2], part((1, 0), (0, -0.01)), "cibin"), (3, [30, 31], part((0, -0.021), (0, -0.03)), "olt"), (4, [7], part((0, 0)), "x")], WAYS)
    edges = network.flow_edges(ways)
    assert sorted(map(tuple, edges.select("way_id", "seq", "u", "v").collect())) == [(1, 0, 1, 2), (1, 1, 2, 3), (2, 0, 9, 2), (3, 0, 30, 31)]
    named = edges.join(ways.select("way_id", "river"), "way_id")
    courses = network.build_courses(named, "river")
    got = {r.course_id: (r.nodes, len(r.synthetic)) for r in courses.collect()}
    assert got == {"olt:1": ([1, 2, 3, 30, 31], 1), "cibin:9": ([9, 2], 0)}
    into, junctions = network.link_courses(courses)
    assert {tuple(r) for r in into.collect()} == {("olt:1", None), ("cibin:9", "olt:1")} and [tuple(r) for r in junctions.collect()] == [("olt:1", 2, "cibin:9")]
    assert network.qa_summary(courses).first().n_courses == 2
    comp = dict(map(tuple, network.components(edges).collect()))
    assert comp == {1: 1, 2: 1, 3: 1, 9: 1, 30: 30, 31: 30}
    groups = network.merge_partial(spark.createDataFrame([(1, "olt", "Q1"), (2, "olt", None), (3, "jiu", ""), (4, "arg", "Q2"), (5, "arg", "Q3"), (6, "arg", None)], "i int, name_key string, wikidata string"))
    assert {r.i: r.group for r in groups.collect()} == {1: "Q1", 2: "Q1", 3: "jiu", 4: "Q2", 5: "Q3", 6: "arg"}
    one = spark.createDataFrame([("g", 1, part((0, 0), (1, 0))), ("g", 2, part((1, 0), (1, 1)))], "g string, o int, part array<struct<lon:double,lat:double>>")
    assert network.grown(one, "g", "o", 0.01).first().used == 2 and network.clustered(one, "g", "o").first()["size"] == 2
    assert len(network.strict(one, "g", "o").first().part) == 3 and network.rings(one, "g", "o").first().part is None


END = "sector_id int, role string, kind string, keys array<string>, place string, road_ref string, county string, course_id string"


def test_sector_resolution(spark):
    courses = spark.createDataFrame([("olt:1", 10000.0, 0.0), ("cibin:9", 4000.0, 900.0)], "course_id string, length_m double, braids_m double")
    ends = spark.createDataFrame([
        (1, "from", "SOURCE", [], "", None, None, "olt:1"), (1, "to", "CONFLUENCE", ["cibin"], "", None, None, "olt:1"),
        (2, "from", "SOURCE", [], "", None, None, "cibin:9"), (2, "to", "MOUTH", [], "", None, None, "cibin:9"),
        (3, "from", "BRIDGE", [], "avrig", "DN 1", None, "olt:1"), (3, "to", "MOUTH", [], "", None, None, "olt:1"),
        (4, "from", "LOCALITY", [], "avrig", None, "SB", "olt:1"), (4, "to", "COUNTY_LIMIT", [], "", None, "SB", "olt:1"),
        (5, "from", "CONFLUENCE", ["jiul de vest"], "", None, None, "olt:1"), (5, "to", "UNKNOWN", [], "", None, None, "olt:1"),
        (6, "from", "DAM", ["vidra"], "", None, None, "olt:1"), (6, "to", "WATERFALL", ["bigar"], "", None, None, "olt:1"),
    ], END)
    keys = spark.createDataFrame([("cibin", "cibin:9"), ("olt", "olt:1"), ("jiul", "jiu:3")], "key string, course_id string")
    into = spark.createDataFrame([("cibin:9", "olt:1"), ("olt:1", None)], "course_id string, receives_into string")
    junctions = spark.createDataFrame([("olt:1", 6000.0, "cibin:9"), ("olt:1", 2000.0, "jiu:3")], "course_id string, m double, tributary string")
    near = spark.createDataFrame([], "course_id string, other string, m double, dist_m double")
    parts = [sectors.source_and_mouth(ends, courses), sectors.confluences(ends, courses, into, junctions, keys, near)]
    located = spark.createDataFrame([("olt:1", "d1", "DAM", "vidra", "", 100.0, 30.0), ("olt:1", "w1", "WATERFALL", "bigar", "", 900.0, 500.0)], "course_id string, feature_id string, feature_kind string, key string, place string, m double, dist_m double")
    parts.append(sectors.features_on(ends, "DAM", located, "dam_named", "dam_by_place", 100))
    parts.append(sectors.features_on(ends, "WATERFALL", located, "waterfall", None, 200))
    areas = spark.createDataFrame([("olt:1", "avrig", "SB", 3000.0, 3500.0)], "course_id string, place string, county string, m_from double, m_to double")
    places = spark.createDataFrame([("olt:1", "avrig", "BV", 3100.0, 200.0)], "course_id string, place string, county string, m double, dist_m double")
    parts.append(sectors.localities(ends, areas, places))
    iv = spark.createDataFrame([("olt:1", "SB", 0.0, 7000.0)], "course_id string, county string, m_from double, m_to double")
    parts.append(sectors.county_limits(ends, sectors.crossings(iv, courses)))
    first = sectors.all_of(parts)
    s = spark.createDataFrame([(i, "olt:1", km, False) for i, km in ((1, 6.0), (2, None), (3, 5.0), (4, 4.0), (5, 1.0), (6, 1.0))], "sector_id int, course_id string, contract_km double, includes_tributaries boolean")
    on = spark.createDataFrame([("olt:1", "b1", "DN 1", "avrig", 3200.0), ("olt:1", "b2", "DN 1", "x", 5000.0)], "course_id string, feature_id string, road_ref string, place string, m double")
    all_ = sectors.all_of([first, sectors.bridges(ends, on, sectors.bridge_windows(s, first, courses))])
    got = {r.sector_id: r for r in sectors.resolve(s, all_).collect()}
    assert (got[1].m_from, got[1].m_to, got[1].status, got[1].confidence) == (0, 6000, "resolved", "high")
    assert (got[2].status, got[2].confidence, got[2].reasons) == ("resolved", "medium", ["contract_km_missing"])
    assert (got[3].m_from, got[3].m_to, got[3].status) == (3200, 10000, "resolved")
    assert (got[4].m_from, got[4].m_to, got[4].confidence) == (3000, 7000, "high")
    assert got[5].status == "unresolved" and got[5].reasons == ["endpoint_unresolved:to"] and got[6].status == "unresolved"
    base = all_.where("sector_id = 5").first()
    assert (base.m, base.confidence, base.method) == (2000, 0.7, "base_name")
    over = sectors.with_overrides(all_, spark.createDataFrame([(5, "to", 5000.0)], "sector_id int, role string, m double"))
    assert sectors.resolve(s.where("sector_id = 5"), over).first().m_to == 5000


def test_same_point_takes_the_next_candidate(spark):
    c = spark.createDataFrame([(1, "from", 100.0, 0.9, "a", "x"), (1, "to", 110.0, 0.8, "b", "y"), (1, "to", 900.0, 0.7, "c", "z")], "sector_id int, role string, m double, confidence double, method string, anchor string")
    s = spark.createDataFrame([(1, 0.8, False)], "sector_id int, contract_km double, includes_tributaries boolean")
    r = sectors.resolve(s, c).first()
    assert (r.m_from, r.m_to) == (100, 900) and "second_best:to" in r.reasons


def test_the_next_candidate_is_sought_among_all(spark):
    near = [(1, "to", 100.0 + i / 100, 0.9, "b", f"y{i:04}") for i in range(1500)]
    c = spark.createDataFrame([(1, "from", 100.0, 0.95, "a", "x"), *near, (1, "to", 900.0, 0.5, "c", "z"), (2, "from", 100.0, 0.9, "a", "x"), (2, "to", 100.0, 0.8, "b", "y")], "sector_id int, role string, m double, confidence double, method string, anchor string")
    s = spark.createDataFrame([(i, 0.8, False) for i in (1, 2, 3)], "sector_id int, contract_km double, includes_tributaries boolean")
    got = {r.sector_id: r for r in sectors.resolve(s, c).collect()}
    assert (got[1].m_from, got[1].m_to) == (100, 900) and "second_best:to" in got[1].reasons
    assert (got[2].status, got[3].status) == ("unresolved", "unresolved")


def test_best_try_and_invariants(spark):
    t = spark.createDataFrame([(1, 0, "review", "low"), (1, 1, "resolved", "medium"), (1, 2, "resolved", "medium")], "sector_id int, try int, status string, confidence string")
    assert sectors.best_of(t).first()["try"] == 1
    r = spark.createDataFrame([(1, 0.0, 10.0, 10.0, 10.0, 10.0, 0.0, True), (2, 5.0, 1.0, -4.0, 9.0, 6000.0, 900.0, False)], "i int, m_from double, m_to double, length_m double, course_m double, max_step_m double, county_gap_m double, on_junction boolean")
    got = {x.i: x.failed for x in sectors.invariants(r).collect()}
    assert got[1] == [] and len(got[2]) == 4


def test_opl(spark, tmp_path):
    lines = ["# x", "n1 v1 dV x25.0 y45.0 T", "n2 v1 dV x25.1 y45.1 Tplace=village,name=R%e2%u%2c%x,bad", "n3 v1 dD x25 y45 T", "n4 v1 dV T", "w10 v1 dV Twaterway=river Nn1,n2", "r20 v1 dV Ttype=waterway Mw10@main,n1@", ""]
    (tmp_path / "a.opl").write_text("\n".join(lines))
    rows = {(r.kind, r.id): r for r in readers.opl(spark, str(tmp_path / "a.opl")).collect()}
    assert set(rows) == {("n", 1), ("n", 2), ("w", 10), ("r", 20)} and rows["n", 2].tags["name"].startswith("Râu")
    assert rows["w", 10].refs == [1, 2] and [tuple(m) for m in rows["r", 20].members] == [("w", 10, "main"), ("n", 1, "")]
    d = readers.opl(spark, str(tmp_path / "a.opl"))
    ways = readers.assemble_ways(d.where("kind = 'w'"), d.where("kind = 'n'"))
    assert [p.lon for p in ways.first().part] == [25.0, 25.1]
    rel = readers.assemble_relations(spark.createDataFrame([(1, [("w", 10), ("w", 99)])], "id long, members array<struct<type:string,ref:long>>"), ways).first()
    assert len(rel.parts) == 1 and rel.missing == 1


def test_extract(spark, tmp_path):
    good = ['{"t":"meta","schema":1,"source":"x"}', '{"t":"way","id":"5","nodes":[1,2],"tags":{"a":"b"}}', "", '{"t":"node","id":"1","coord":[1.0,2.0]}']
    (tmp_path / "e.jsonl").write_text("\n".join(good))
    e = readers.extract(spark, str(tmp_path / "e.jsonl"))
    assert e["way"].first().nodes == [1, 2] and e["node"].count() == 1 and e["rel"].count() == 0
    for bad in (good[1:], [good[0], *good], [*good, '{"t":"zzz"}'], [*good, "{nope"], ['{"t":"meta","schema":2}']):
        (tmp_path / "b.jsonl").write_text("\n".join(bad))
        with pytest.raises(ValueError):
            readers.extract(spark, str(tmp_path / "b.jsonl"))


def test_texts_and_shapes(spark, tmp_path):
    (tmp_path / "l.txt").write_text("D.S. ALBA\nAPE CURGATOARE\n1. Sebes  izvor - baraj  12 km\n  2 Cugir   izvor - conf.\nLACURI\n3  Oasa  toata\nD.S. ARAD\n1  Mures  x\n")
    rows = [tuple(r) for r in readers.listing(spark, str(tmp_path / "l.txt")).select("county", "section", "nr", "name", "rest").orderBy("county", "nr").collect()]
    assert rows == [("ALBA", "river", 1, "Sebes", "12 km"), ("ALBA", "river", 2, "Cugir", None), ("ALBA", "lake", 3, "Oasa", None), ("ARAD", "lake", 1, "Mures", None)]
    f = readers.fixed_width(spark, str(tmp_path / "l.txt"), {"a": (0, 4), "b": (5, 0)}).orderBy("line").first()
    assert (f.a, f.b) == ("D.S.", "ALBA")
    body = struct.pack("<i4d2i2i", 3, 0, 0, 1, 1, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 5, 5, 6, 6)
    (tmp_path / "x.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    s = readers.shapefile(spark, str(tmp_path / "x.shp")).first()
    assert s.number == 1 and [[(p.lon, p.lat) for p in q] for q in s.parts] == [[(0, 0), (1, 1)], [(5, 5), (6, 6)]]
    (tmp_path / "g.seq").write_text('\x1e{"id":"a","properties":{"water":"lake"},"geometry":{"type":"Polygon","coordinates":[[[1,2]]]}}\n\x1e{"id":"b","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}\n')
    assert [r.id for r in readers.geojson_seq(spark, str(tmp_path / "g.seq"), filters.area_wanted).collect()] == ["a"]


def test_other_sources(spark, tmp_path):
    pages = {0: [{"id": 1}, {"id": 2}], 2: [{"id": 2}, {"id": 3}], 4: []}
    assert [r["id"] for r in readers.pages_by_skip(lambda s: (pages[s], None))] == [1, 2, 3]
    assert readers.labelled("<p>Telefon: <b>0722</b></p><div>Adresa:</div><div>Str. X</div>", {"phone": ["telefon"], "address": ["adresa"], "mail": ["e-mail"]}) == {"phone": "0722", "address": "Str. X", "mail": None}
    reg = readers.Registry()
    reg.add(type("S", (), {"name": "a", "collect": staticmethod(lambda s: s.range(1))}))
    reg.add(object())
    assert list(reg.collect(spark)) == ["a"] and len(reg.warnings) == 1
    empty = readers.json_array(spark, str(tmp_path / "none.json"), readers.T.StructType([readers.T.StructField("a", readers.T.StringType())]), optional=True)
    assert empty.count() == 0
    place = sinks.write_snapshot({"t": spark.range(3)}, str(tmp_path / "snap"), 2)
    assert readers.snapshot(spark, place, 2, ["t"])["t"].count() == 3 and readers.snapshot(spark, place, 3, ["t"]) is None and readers.snapshot(spark, str(tmp_path / "no"), 2, ["t"]) is None


def test_sinks(spark, tmp_path):
    sinks.write_jsonl_gz([{"b": 1, "a": "é"}], str(tmp_path / "a.gz"))
    first = (tmp_path / "a.gz").read_bytes()
    sinks.write_jsonl_gz([{"a": "é", "b": 1}], str(tmp_path / "b.gz"))
    assert first == (tmp_path / "b.gz").read_bytes()
    with pytest.raises(ValueError):
        sinks.guarded_write(spark.range(0), str(tmp_path / "g"))
    with pytest.raises(ValueError):
        sinks.contained(str(tmp_path), "../x")
    with pytest.raises(ValueError):
        sinks.outside(str(tmp_path), str(tmp_path / "x"))
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "slug string, n int, wide string")
    thin, wide = sinks.split_column(rows, "slug", "wide")
    assert "wide" not in thin.columns and [tuple(r) for r in wide.collect()] == [("b", "x")]
    up = sinks.upsert(rows, spark.createDataFrame([("a", 9, "new")], rows.schema), ["slug"])
    assert {r.slug: r.n for r in up.collect()} == {"a": 9, "b": 2}
    sinks.write_extract(spark.createDataFrame([("meta", 1)], "t string, schema int"), spark.createDataFrame([("way", "2"), ("node", "1")], "t string, id string"), str(tmp_path / "ex"), ["t", "id"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "ex")).collect()]
    assert '"meta"' in lines[0] and '"node"' in lines[1]


def test_strict_rules(spark):
    rows = spark.createDataFrame([("a", 1), ("b", -1)], "k string, n int")
    assert [tuple(r) for r in filters.violations(rows, "k", {"positive": F.col("n") > 0}).collect()] == [("b", "positive")]
    with pytest.raises(PySparkException):
        filters.strict(rows, "k", {"positive": F.col("n") > 0}).collect()
    assert filters.lenient(rows, F.col("n") > 0).count() == 1


def test_sequence_alignment(spark):
    rows = spark.createDataFrame([("k", i, a, b) for i, (a, b) in enumerate([("x", "q"), ("y", "x"), ("z", "y"), ("w", None)])], "k string, o int, a string, b string")
    assert sorted(tuple(r)[1:] for r in joins.align_sequences(rows, "k", "a", "b", "o").collect()) == [("w", None), ("x", "x"), ("y", "y"), ("z", None)]


def test_limiter_ignores_refused_hits(spark):
    hits = [0, 1, 2, 3, 4, 5, 599, 600, 601, 602]
    e = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate(hits)], "k string, i int, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = [(r.allowed, r.retry_after) for r in stateful.rate_limited(e, "k", "ts", "i").orderBy("i").collect()]
    assert got == [(True, 0)] * 5 + [(False, 595), (False, 1), (True, 0), (True, 0), (True, 0)]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([("k", i, float(i)) for i in range(7)], "k string, i int, t double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, d in (("limited", stateful.rate_limited_stream(stream, "k", "ts", "i")), ("once", stateful.deduped_stream(stream, "k", "ts"))):
        q = d.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert spark.table("limited").where("allowed").count() == 5 and spark.table("once").count() == 1


def test_ttl(spark):
    e = spark.createDataFrame([("k", 0, 0.0, True), ("k", 1, 59.0, True), ("k", 2, 60.0, False), ("k", 3, 61.0, True), ("k", 4, 62.0, True)], "k string, i int, t double, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.outcome for r in stateful.ttl_deduped(e, "k", "ts", "i", F.col("ok")).orderBy("i").collect()] == ["run", "cached", "failed", "run", "cached"]


def test_voronoi_tiles_the_course(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(f"g{i % 7}", i, "x", r.random() if i % 3 else None) for i in range(60)], "g string, ord int, name string, course_frac double")
    got = {}
    for x in windows.voronoi(rows, "g", "ord").collect():
        got.setdefault(x.g, []).append((x.v_from, x.v_to))
    for spans in got.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == 1 and all(abs(a[1] - b[0]) < 1e-12 for a, b in zip(spans, spans[1:]))


def test_partitions_do_not_matter(spark):
    rows = spark.range(500).select((F.col("id") % 9).alias("g"), F.col("id").alias("ord"), (F.col("id") * 37 % 100 / 100.0).alias("course_frac"), F.lit("n").alias("name"))
    a, b = (sorted(map(tuple, windows.voronoi(rows.repartition(n), "g", "ord").select("ord", "v_from", "v_to").collect())) for n in (1, 7))
    assert a == b


def test_places_named(spark):
    from torrentine.operators import sectors

    wanted = [(1, "zarnesti"), (2, "zarnestii"), (3, "bran"), (4, "brann"), (5, ""), (6, None), (7, "rasnov"), (8, "xarnesti")]
    places = [(10, "zarnesti"), (11, "bran"), (12, "rasnoava"), (13, "zarnestul"), (14, None), (15, "")]
    w, p = spark.createDataFrame(wanted, "w long, core string"), spark.createDataFrame(places, "p long, core string")
    got = {(r.w, r.p) for r in sectors.places_named(w, p, "w", "p", 0.85).collect()}
    assert got == {(1, 10), (2, 10), (3, 11), (4, 11), (7, 12)}
    assert sectors.places_named(w, p.limit(0), "w", "p").count() == 0


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c d.bin").write_bytes(b"x")
    (tmp_path / ".hidden").write_bytes(b"y")
    with open(tmp_path / "large.bin", "wb") as f:  # more than a row may hold, without blocks on disk
        f.seek((1 << 31) + 10)
        f.write(b"end")
    big = hashlib.sha256()
    for _ in range(128):
        big.update(bytes(1 << 24))
    big.update(bytes(10) + b"end")
    want = {"a.bin": (3000, hashlib.sha256(b"abc" * 1000).hexdigest()), "b.bin": (0, hashlib.sha256(b"").hexdigest()), "c d.bin": (1, hashlib.sha256(b"x").hexdigest()), "large.bin": ((1 << 31) + 13, big.hexdigest())}
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert got == want
    assert [r.length for r in readers.file_hashes(spark, f"file://{tmp_path}/a.bin").collect()] == [3000] and readers.file_hashes(spark, str(tmp_path / "none")).count() == 0


def test_interval_joins_of_a_hot_course(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        course, at = ("hot" if i % 4 else f"c{i % 12}"), rng.choice([rng.random() * 50, float(rng.randrange(50))])
        rows.append((i, course, at, at + rng.choice([0.0, 0.5, 1.0, rng.random() * 3, -1.0, 45.0 if i % 50 == 1 else 2.0])))
    rows += [(400, "hot", float("-inf"), 3.0), (401, "hot", 49.0, float("inf")), (402, "hot", None, 3.0), (403, None, 1.0, 2.0), (404, "lone", 1.0, 1.0)]
    points = [(c, float(x) / 4) for c in ("hot", "c0", "lone", "none", None) for x in range(-8, 216, 3)]
    d = spark.createDataFrame(rows, "item long, course string, s double, e double")
    p = spark.createDataFrame(points, "course string, at double")
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    pairs = {(c, x[0], y[0]) for x in known for y in known if (c := x[1]) == y[1] and x[0] < y[0] and x[2] < y[3] and y[2] < x[3] and min(x[3], y[3]) - max(x[2], y[2]) > 0.1}
    got = joins.interval_overlaps(d, "course", "item", "s", "e", 0.1).collect()
    assert len(got) == len(pairs) > 500 and {(r.course, r.a, r.b) for r in got} == pairs
    shortest = {(c, x): min(((r[3] - r[2], r[0]) for r in known if r[1] == c and r[2] <= x < r[3]), default=(0, None))[1] for c, x in points}
    got = joins.smallest_interval(p, d, "course", "at", "item", "s", "e").collect()
    assert len(got) == len(shortest) and {(r.course, r.at): r.item for r in got} == shortest
    empty = joins.interval_overlaps(d.where("false"), "course", "item", "s", "e", 0.1)
    assert empty.count() == 0 and joins.smallest_interval(p, d.where("false"), "course", "at", "item", "s", "e").where("item is not null").count() == 0


def test_limiter_parts_keys_at_still_times(spark):
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([0.0, 1.0, 40.0, 120.0, 599.0, 600.0, 601.0, 1300.0])
        rows.append((rng.choice(["hot", "hot", "a", None]), i, int(t), i % 3 > 0))
    rows += [("hot", 600, None, True), (None, 601, None, False)]
    e = spark.createDataFrame(rows, "k string, i long, s long, ok boolean").selectExpr("k", "i", "timestamp_seconds(s) AS ts", "ok")
    want, cached = {}, {}
    for key in ("hot", "a", None):
        live, done = [], None
        for _, i, s, ok in sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: (r[2], r[1])):
            live, passed, wait = stateful.decide(live, float(s), 600.0, 2)
            want[i] = passed, wait
            if done is not None and s - done < 60:
                cached[i] = "cached"
            else:
                cached[i], done = ("run", s) if ok else ("failed", None)
    want |= {600: (True, 0), 601: (True, 0)}
    cached |= {600: "run", 601: "failed"}
    assert {r.i: (r.allowed, r.retry_after) for r in stateful.rate_limited(e, "k", "ts", "i", most=2).collect()} == want
    assert {r.i: r.outcome for r in stateful.ttl_deduped(e, "k", "ts", "i", F.col("ok")).collect()} == cached


def test_close_pairs_are_all_near_ones():
    rng = np.random.default_rng(1)
    for lat in (45.0, 88.9, -89.95):
        left, right = (np.c_[rng.uniform(179.8, 180.2, n) if lat < 80 else rng.uniform(-180, 180, n), rng.uniform(lat, lat + 0.05, n)] for n in (150, 120))
        right[:, 0] -= 360 * (right[:, 0] > 180)
        for metres in (250.0, 5000.0):
            want = set(map(tuple, np.argwhere(kernels.geodesic_m(left[:, :1], left[:, 1:], right[:, 0], right[:, 1]) <= metres).tolist()))
            found = [(a, b) for i, j in chains.close_pairs(left, right, metres, block=100) for a, b in zip(i.tolist(), j.tolist())]
            assert want <= set(found) and len(found) == len(set(found))
    assert not list(chains.close_pairs(left[:0], right, 10.0))[0][0].size
