"""Scalars and kernels by hand cases and properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from torrentine.functions import geo, identity, kernels, limits, text

# A course of five parts in scrambled order with one repeat, and its published numbers.
COURSE = [np.array(p) for p in (
    [[26.036, 45.3], [26.042, 45.285], [26.05, 45.27]], [[26.024, 45.33], [26.03, 45.315], [26.036, 45.3]], [[26.074, 45.21], [26.078, 45.195], [26.08, 45.18]],
    [[26.064, 45.24], [26.07, 45.225], [26.074, 45.21]], [[26.036, 45.3], [26.042, 45.285], [26.05, 45.27]],
)]
FRACTIONS = {(26.024, 45.33): 0.0, (26.036, 45.3): 0.200352, (26.05, 45.27): 0.403533, (26.064, 45.24): 0.606713, (26.08, 45.18): 1.0, (26.057, 45.255): 0.403533}


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_published_course():
    parts = kernels.order_parts(COURSE)
    assert tuple(parts[0][0]) == (26.024, 45.33) and tuple(parts[-1][-1]) == (26.08, 45.18)
    for (x, y), f in FRACTIONS.items():
        assert abs(kernels.fraction_at_point(COURSE, x, y) - f) < 1e-6
    assert abs(kernels.km_to_fraction(COURSE, 10, compat=True) - 0.981699) < 1e-6 and abs(kernels.km_to_fraction(COURSE, 10) - 0.578167) < 1e-5
    assert kernels.km_to_fraction(COURSE, 0, compat=True) == 0 and kernels.km_to_fraction(COURSE, 999) == 1


def test_line_measures():
    line = np.array([[25.0, 45.0], [25.0, 45.01], [25.01, 45.01]])
    m = kernels.measures(line)
    assert abs(m[1] - 1111.95) < 0.1 and m[-1] > m[1]
    a, b = kernels.substring(line, 0, 700), kernels.substring(line, 700, m[-1])
    assert abs(kernels.measures(a)[-1] + kernels.measures(b)[-1] - m[-1]) < 0.05
    at, d = kernels.locate(line, 25.001, 45.005)
    assert abs(at - 555.97) < 1 and abs(d - 78.6) < 1
    assert kernels.locate(line, 24, 44)[0] == 0 and len(kernels.substring(line, 5, 5)) == 2
    assert len(kernels.simplify(np.array([[0, 0], [1, 1e-6], [2, 0]]), 1e-4)) == 2
    assert kernels.hausdorff_m(line, line) < 1e-6 and kernels.hausdorff_m(line[:2], line) > 700
    assert kernels.coverage(line, line) == 1 and len(kernels.sampled(np.zeros((79, 2)))) == 79 and len(kernels.sampled(np.zeros((80, 2)))) == 40


def test_whole_vertex_slice():
    line = [np.array([[25.0, 45.0 + i / 100] for i in range(11)])]
    got = kernels.slice_whole(line, 0.25, 0.55)
    assert [round(y, 2) for _, y in got[0]] == [45.03, 45.04, 45.05, 45.06] or [round(y, 2) for _, y in got[0]][::-1] == [45.03, 45.04, 45.05, 45.06]
    assert kernels.slice_whole([np.array([[1.0, 1.0]])], 0, 1) == []


def test_vincenty():
    assert abs(kernels.vincenty_m(0, 0, 0, 1) - 110574.39) < 0.1 and kernels.vincenty_m(5, 5, 5, 5) == 0
    assert abs(kernels.vincenty_m(-5.71475, 50.06632, -3.07009, 58.64402) - 969_954) < 200


SQUARE = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]])
HOLE = np.array([[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]])


def test_polygons():
    assert kernels.point_in_polygon(3, 3, [SQUARE, HOLE]) and not kernels.point_in_polygon(1.5, 1.5, [SQUARE, HOLE]) and not kernels.point_in_polygon(5, 1, [SQUARE])
    assert kernels.polygon_distance_m(3, 3, [SQUARE]) == 0 and abs(kernels.polygon_distance_m(5, 1, [SQUARE]) - 111_180) < 200
    assert np.allclose(kernels.border_between(np.array([3.0, 3.0]), np.array([5.0, 3.0]), [SQUARE]), [4, 3])
    spans = kernels.inside_spans(np.array([[-1.0, 1.5], [0.5, 1.5], [3.0, 1.5], [6.0, 1.5]]), [SQUARE])
    assert len(spans) == 1 and abs(spans[0][1] - spans[0][0] - 4 * 111_195 * math.cos(math.radians(1.5))) < 300
    assert abs(kernels.clip_ring(SQUARE, (1, 1, 9, 3))[:, 0].min() - 1) < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.floats(-3, 7), st.floats(-3, 7))
def test_native_and_kernel_agree_on_points(x, y):
    inside = 0 <= x < 4 and 0 <= y < 4
    if all(abs(v - e) > 1e-9 for v in (x, y) for e in (0, 4)):
        assert kernels.point_in_polygon(x, y, [SQUARE]) == inside


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_limit_parser_never_raises(t):
    assert limits.parse(t)["scope"] in ("interval", "whole_county", "whole_course", "locality_list", "empty", "unparsed")


@pytest.mark.parametrize(("t", "want"), [
    ("Izvoare – conf. râul Olt", ("interval", "SOURCE", "CONFLUENCE", "Olt")),
    ("Baraj Baciu - Pod Stefan din loc.Slatina", ("interval", "DAM", "BRIDGE", "Stefan")),
    ("Izvoare-DN 67 D Baia", ("interval", "SOURCE", "ROAD", None)),
    ("coada lacului Zetea - baraj Zetea", ("interval", "LAKE_UPSTREAM", "DAM", "Zetea")),
    ("aval de loc. Bran – amonte Zărnești", ("interval", "LOCALITY", "LOCALITY", "Zărnești")),
    ("Limita jud. HD - vărsare în Mureș", ("interval", "COUNTY_LIMIT", "CONFLUENCE", "Mureș")),
    ("cascada Bigăr - Valea Fetii", ("interval", "WATERFALL", "CONFLUENCE", "Valea Fetii")),
    ("drum forestier Valea Rea - granița cu Ucraina", ("interval", "ROAD", "BORDER", "Ucraina")),
    ("Judeţul Alba", ("whole_county", None, None, None)), ("toată lungimea", ("whole_course", None, None, None)),
    ("Izvoare – vărsare lac Pădureni.", ("interval", "SOURCE", "LAKE_UPSTREAM", "Pădureni")),
    ("Izvoare – vărsare în lacul Colibița", ("interval", "SOURCE", "LAKE_UPSTREAM", "Colibița")),
    ("Izvoare – conf.cu Râul Olt", ("interval", "SOURCE", "CONFLUENCE", "Olt")), ("Izvoare – conf. cu valea Braia", ("interval", "SOURCE", "CONFLUENCE", "valea Braia")),
    ("De la Barajul Vidraru până la ieșire din județ", ("interval", "DAM", "COUNTY_LIMIT", None)), ("Cetatea – Gherla", ("interval", "LOCALITY", "LOCALITY", "Gherla")),
    ("De la valea Braia – până la conf. cu Jiul de est", ("interval", "CONFLUENCE", "CONFLUENCE", "Jiul de est")), ("Lac Hațeg – Lac Subcetate", ("interval", "LAKE_DOWNSTREAM", "LAKE_UPSTREAM", "Subcetate")),
    ("limita cu jud. Covasna-până la conf. cu pârâul Sibiciu", ("interval", "COUNTY_LIMIT", "CONFLUENCE", "Sibiciu")),
    ("Localitatea Ionești- Frontieră cu Ungaria cu afluenții", ("interval", "LOCALITY", "BORDER", "Ungaria")), ("aval lac Bicaz - amonte lac Izvorul", ("interval", "LAKE_DOWNSTREAM", "LAKE_UPSTREAM", "Izvorul")),
    ("Limita județ Ilfov, zona satului Zurbaua – limită județ Ilfov, zona satului Cernica", ("interval", "COUNTY_LIMIT", "COUNTY_LIMIT", "Ilfov")),
    ("între Bran și Zărnești", ("unparsed", None, None, None)), ("intrare în jud. Alba - ieșire din jud. Alba", ("whole_county", None, None, None)), ("Județ Brașov", ("whole_county", None, None, None)),
    ("pe raza județului Bistrița-Năsăud", ("whole_county", None, None, None)), ("Artificial, județ Sibiu", ("unparsed", None, None, None)), ("Bacău", ("unparsed", None, None, None)),
    ("Sebeș, Alba, Petrești", ("locality_list", None, None, None)), ("-", ("empty", None, None, None)), ("xx 12 yy", ("unparsed", None, None, None)),
])
def test_limits(t, want):
    p = limits.parse(t)
    ends = [p[e] or {} for e in ("from", "to")]
    assert (p["scope"], ends[0].get("kind"), ends[1].get("kind"), ends[1].get("target")) == want


@pytest.mark.parametrize(("name", "keys", "stem"), [
    ("Râul Geoagiu Inferior", ["geoagiu"], "geoagi"), ("Valea Iadului", ["valea iadului", "iadului", "valea iadu", "iadu"], "iad"), ("Jiul de Vest", ["jiul de vest", "jiul"], None),
    ("Olt sector Făgăraș", ["olt"], None), ("Pr. Buzăului II", ["buzaului", "buzau"], None), ("Dunărea cu afluenții", ["dunarea"], None), ("", [], ""), (None, [], ""), ("Valea Pojorâtei", None, "pojorat"), ("Pojorâta", None, "pojorat"),
])
def test_river_keys(spark, name, keys, stem):
    r = one(spark, text.river_match_keys(F.lit(name).cast("string")), text.stem_key(F.lit(name).cast("string")))
    assert (keys is None or r[0] == keys) and (stem is None or r[1] == stem)


def test_folding_is_idempotent_and_the_same_in_both_forms(spark):
    r = random.Random(1)
    words = ["Ştefan  cel_Mare!", "ȚĂRII (de) Jos", "Ünïcödé-x", "Crişul Répéde", "a\tb", "", "ÅÂå"] + ["".join(chr(r.randint(32, 0x24F)) for _ in range(12)) for _ in range(40)]
    words = [w for w in words if not any(c in w for c in "ªº²³¹¼½¾ĳĲǄǅǆǇǈǉǊǋǌǱǲǳŀĿŉſ¨¯´¸µ\xa0\x85")]
    d = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold(F.col("w")).alias("a"), text.fold_any("w").alias("b"), text.fold(text.fold(F.col("w"))).alias("c"))
    for row in d.collect():
        assert row.a == row.c
    assert sum(row.a == row.b for row in d.collect()) >= len(words) - 3


def test_text_helpers(spark):
    lit = F.lit
    assert one(spark, text.split_aliases(lit("Aa (Bb, Cc; aa)")))[0] == ["Aa", "Bb", "Cc"]
    assert one(spark, text.parent_code(lit("I-1-2-0-0")), text.parent_code(lit("I-0-0"))) == ("I-1-0-0-0", None)
    assert one(spark, text.parse_size(lit("0,24 Ha")))[0] == (0.24, "ha", "0,24 Ha") and one(spark, text.parse_size(lit("-")))[0] == (None, None, "-")
    assert one(spark, text.canonical_county(lit("caras severin")), text.canonical_county(lit("hd")), text.canonical_county(lit("nowhere land"))) == ("Caraș-Severin", "Hunedoara", "Nowhere Land")
    assert one(spark, text.fence(lit("a ``` b")))[0].startswith("````\n") and one(spark, text.escape_inline(lit("*x*")))[0] == r"\*x\*"
    assert [one(spark, text.url_policy(lit(u)))[0] for u in ("", "ftp://x", "http://u:p@x/", "http://10.1.2.3/x", "https://x:8080/", "https://x.ro/a")] == ["empty", "scheme", "credentials", "private_host", "port", None]
    assert one(spark, text.sanitize_url(lit("https://u:p@h/x?token=1&b=2#f")))[0] == "https://h/x?token=REDACTED&b=2"
    assert [one(spark, text.safe_link(lit(u)))[0] is None for u in ("https://a.ro/x", "http://a.ro", "tel:+40 722", "javascript:x")] == [False, True, False, True]
    assert one(spark, text.phone_plausible(lit("0722 123 456")), text.phone_plausible(lit("12"))) == (True, False)
    assert [g["gram"] for g in one(spark, text.ngrams(lit("a b c"), 2))[0]] == ["a b", "b c", "a", "b", "c"]
    assert one(spark, text.road_ref_match(lit("DN 1"), lit("DN1A")), text.road_ref_match(lit("DN 1"), lit("DN12"))) == (True, False)
    assert one(spark, text.road_ref_match(lit("DN1A"), lit("dn-1")), text.road_ref_match(lit(""), lit("A")), text.road_ref_match(lit(None).cast("string"), lit("A"))) == (True, False, False)
    assert one(spark, text.split_note(lit("Olt (aval)")))[0] == ("Olt", "aval") and one(spark, text.first_measure(lit("a 1.234,5 km b 3 km"), "km"))[0] == 3.0
    assert one(spark, text.token_core_match(lit("olt superior"), lit("olt")), text.token_core_match(lit("a b c"), lit("a b d"))) == (True, True)
    assert one(spark, text.contains_folded(lit("Păstrăv"), "pastr"))[0] and one(spark, text.name_flags(lit("Ştiuca Дунай")))[0] == ["legacy_orthography", "non_latin"]


def test_geo_columns(spark):
    lit = F.lit
    assert abs(one(spark, geo.haversine_km(lit(0.0), lit(0.0), lit(1.0), lit(0.0)))[0] - 111.19) < 0.01
    assert one(spark, geo.haversine_km(lit(None).cast("double"), lit(0.0), lit(1.0), lit(0.0)))[0] is None
    c = one(spark, geo.clip_segment(lit(-1.0), lit(1.0), lit(3.0), lit(1.0), (0, 0, 2, 2)), geo.clip_segment(lit(-1.0), lit(5.0), lit(3.0), lit(5.0), (0, 0, 2, 2)))
    assert (c[0]["a"]["lon"], c[0]["b"]["lon"]) == (0, 2) and c[1] is None
    pts = F.array(*[F.struct(lit(float(x)).alias("lon"), lit(float(y)).alias("lat")) for x, y in SQUARE])
    assert one(spark, geo.shoelace_deg2(pts), geo.extent(F.array(pts)), geo.coordinate_count(F.array(pts, pts))) == (16.0, (0, 0, 4, 4), 8)
    assert one(spark, F.size(geo.round_part(F.array(*[F.struct(lit(x).alias("lon"), lit(1.0).alias("lat")) for x in (1.000001, 1.000002, 2.0)]))))[0] == 2


def test_identity(spark):
    lit = F.lit
    assert one(spark, identity.iso_date(lit(31), lit(2), lit(2023)), identity.iso_date(lit(1), lit(2), lit(2023))) == (None, "2023-02-01")
    now = lit("2024-03-01").cast("timestamp")
    assert [one(spark, identity.is_stale(lit(d).cast("timestamp"), now))[0] for d in ("2024-01-31 00:00:00", "2024-01-31 00:00:01", None)] == [True, False, True]
    assert identity.geometry_token({"b": [1, -0.0], "a": None}) == '{"a":null,"b":[3ff0000000000000,0000000000000000]}'
    small = one(spark, identity.shrink_to_fit([("a", lit("x")), ("b", lit("y" * 50))], 20), identity.shrink_to_fit([("a", lit("x"))], 3))
    assert small == ('{"a":"x"}', "{}")
    assert one(spark, identity.active_exception(lit("approved"), lit("2024-05-01T00"), F.to_date(lit("2024-05-01"))), identity.active_exception(lit("approved"), lit(None).cast("string"), F.to_date(lit("2024-05-01")))) == (True, False)


def test_limits_are_read_in_time_that_grows_with_the_text():
    """Long texts of one kind of token, nested words and notes: none raises, none takes long."""
    import time

    texts = ["-" * 100_000, "- " * 50_000, "a - " * 25_000, "aval " * 10_000 + "- y", "aval " * 10_000, "x-sat " * 16_000, "conf x-sat " * 9000, "(" * 50_000, "(a)" * 30_000, "(a-sat b) " * 10_000]
    texts += ["pana la " * 12_000, "a, " * 30_000, "pod din " * 12_000, "cu afluenti " * 8000, "jud. " * 20_000, "(x-sat" * 16_000 + ")", "limita " * 14_000]
    for t in texts:
        began = time.perf_counter()
        assert limits.parse(t)["scope"] in ("interval", "empty", "unparsed", "locality_list")
        assert time.perf_counter() - began < 5, t[:20]
    deep = limits.parse("aval amonte " * 400 + "Bran - Avrig")
    assert (deep["from"]["kind"], deep["from"]["target"], deep["from"]["qualifier"]) == ("LOCALITY", "Bran", "downstream")


@pytest.mark.parametrize(("t", "want"), [
    ("Pod DN 7 (km 3) din loc. Avrig – baraj Olt", ("BRIDGE", None, "Avrig", "DN 7")), ("podul vechi de fier CFR de la Turda - vărsare", ("BRIDGE", None, "Turda", "CFR")), ("Pod Stefan de la Slatina - vărsare", ("BRIDGE", "Stefan", "Slatina", None)),
    ("pod rutier DN 7 C - vărsare", ("BRIDGE", None, None, "DN 7C")), ("Pod - vărsare", ("BRIDGE", None, None, None)), ("pod la Avrig - vărsare", ("BRIDGE", None, "Avrig", None)), ("Pod Mare din sat Bran cu afluenții - vărsare", ("BRIDGE", None, "Bran", None)),
])
def test_bridges_of_limits(t, want):
    f = limits.parse(t)["from"]
    assert (f["kind"], f["target"], f["locality_hint"], f["road_ref"]) == want


def test_kernels_over_columns(spark):
    """Forms of kernels on columns: places on lines, midpoints, samples; null lines and lines without points."""
    line = [(25.0, 45.0), (25.1, 45.0), (25.1, 45.1)]
    rows = [(1, [line]), (2, [line[:2], line[1:]]), (3, None), (4, [])]
    d = spark.createDataFrame(rows, "i int, g array<array<struct<lon:double,lat:double>>>")
    p = F.get("g", F.lit(0))
    got = d.select(
        "i", kernels.point_at_udf("g", F.lit(0.5)).alias("at"), kernels.midpoint_udf("g").alias("mid"), kernels.resample_udf(p, F.lit(1000.0)).alias("dense"), kernels.km_fraction_udf("g", F.lit(1.0)).alias("km"),
        kernels.fraction_udf("g", F.lit(25.1), F.lit(45.0)).alias("f"), geo.part_length_km(p).alias("long"),
    ).collect()
    parts = [np.array(line)]
    for r, own in zip(got, (parts, [parts[0][:2], parts[0][1:]])):  # fractions go along the parts from the north, the midpoint along them as they come
        assert np.allclose(r.at, kernels.point_at_fraction(own, 0.5), atol=1e-6) and np.allclose(r.mid, kernels.midpoint(parts), atol=1e-6)
        assert abs(r.f - kernels.fraction_at_point(own, 25.1, 45.0)) < 1e-9 and abs(r.km - 1 / 18.98) < 0.001
    assert abs(got[0].f - 0.4145) < 0.001
    total = kernels.geodesic_measures(parts[0])[-1]
    assert abs(kernels.locate(parts[0], *got[0].mid)[0] - total / 2) < 1
    assert len(got[0].dense) == int(1000 * got[0].long // 1000) + 2 and got[2].mid is None and got[2].dense is None and got[3].mid is None and got[3].at is None
    assert np.allclose(got[0].dense[0], line[0]) and np.allclose(got[0].dense[-1], line[-1])


def test_nearest_place_of_a_line():
    part = np.array([(25.0, 45.0), (25.1, 45.0), (25.1, 45.1)])
    r = random.Random(4)
    dense = kernels.resample(part, 1.0)
    for _ in range(40):
        x, y = 25 + r.uniform(-0.05, 0.15), 45 + r.uniform(-0.05, 0.15)
        m, dist = kernels.locate(part, x, y)
        far = kernels._pairwise_m(np.array([[x, y]]), dense)[0]
        assert abs(dist - far.min()) < 0.01 * far.min() + 1 and abs(m - np.argmin(far)) < 40 + 0.02 * dist
        d, along, share = kernels._project(part, x, y)
        assert 0 <= share <= 1 and d <= np.hypot(*(part - [x, y]).T).min() + 1e-12
