"""Limits to sectors in one plan, over a small country made by hand."""

import numpy as np
import pytest

from torrentine.functions import kernels
from torrentine.operators import dispatch
from torrentine.operators.dispatch import World
from torrentine.operators.sectors import near_spellings as sectors_near

P = "struct<lon:double,lat:double>"


def pts(a):
    return [(float(x), float(y)) for x, y in a]


def box(x0, y0, x1, y1):
    return pts([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


OLT = pts([(25.0 + 0.05 * i, 45.0) for i in range(21)])  # runs east for a degree
SIDE = pts([(25.7, 45.2), (25.7, 45.0)])


@pytest.fixture(scope="module")
def world(spark):
    courses = [("olt", OLT, ["olt"], 0.0, None), ("cibin", SIDE, ["cibin"], 0.0, "olt"), ("jiu", pts([(26.5, 45.0), (26.6, 45.0), (26.7, 45.1)]), ["jiu"], None, None)]
    areas = [
        (1, "lake", "vidra", [box(25.2, 44.99, 25.25, 45.01)]), (2, "lake", None, [box(25.4, 44.99, 25.42, 45.01)]), (3, "locality", "avrig", [box(25.3, 44.98, 25.35, 45.02)]),
        (4, "county", "Sibiu", [box(25.1, 44.5, 25.6, 45.5)]), (5, "county", "Alba", [box(25.6, 44.5, 25.8, 45.5), ]), (6, "county", "Brașov", [box(25.8, 44.5, 25.9, 45.5)]), (7, "county", "Sibiu", [box(25.95, 44.5, 26.05, 45.5)]), (8, "country", "", [box(24.0, 44.0, 25.92, 46.0)]),
    ]
    over = lambda x: pts([(x, 44.999), (x, 45.001)])
    ways = [(11, over(25.12), ["DN 7"], [], False), (12, over(25.62), ["DN 7"], [], False), (13, over(25.78), [], [], None)]
    places = [(1, "turnu", 25.45, 45.005), (2, "bradu", 25.52, 45.02), (3, "talmaciu", 25.63, 45.01), (4, "bradu", 25.65, 45.02)]
    return World(
        spark.createDataFrame(courses, f"course_id string, part array<{P}>, keys array<string>, braids_m double, receives_into string"),
        spark.createDataFrame([("olt", float(kernels.geodesic_measures(np.array(OLT))[14]), "cibin")], "course_id string, m double, tributary string"),
        spark.createDataFrame(areas, f"area long, kind string, core string, rings array<array<{P}>>"),
        spark.createDataFrame(ways, f"way_id long, part array<{P}>, refs array<string>, names array<string>, rail boolean"),
        spark.createDataFrame([(21, "DAM", "oasa", 25.3, 45.0003), (22, "WATERFALL", "bigar", 25.15, 45.001)], "feature_id long, kind string, core string, lon double, lat double"),
        spark.createDataFrame(places, "place_id long, core string, lon double, lat double"),
    )


# sector: limits, size, county, course, expected ends as longitudes on the main course, status, reasons
CASES = {
    1: ("Izvoare – vărsare", "79 km", "Sibiu", "olt", (25.0, 26.0), "resolved", []),
    2: ("Izvoare - coada lacului Vidra", "16 km", "Sibiu", "olt", (25.0, 25.2), "resolved", []),
    3: ("aval lac Vidra - conf. râul Cibin", "35 km", "Sibiu", "olt", (25.25, 25.7), "resolved", []),
    4: ("Baraj Oașa – amonte Avrig", None, "Sibiu", "olt", (25.3, 25.35), "unresolved", ["contract_km_missing", "empty_sector"]),  # a locality is entered there, so both ends are one place
    5: ("toată lungimea", "3 ha", "Sibiu", "olt", (25.0, 26.0), "resolved", ["contract_unit_ha"]),
    6: ("Județul Sibiu", "39 km", "Sibiu", "olt", (25.1, 25.6), "resolved", ["county_interval_multiple"]),
    7: ("Turnu, Avrig, Bradu", "20 km", "Sibiu", "olt", (25.3, 25.52), "review", ["endpoint_confidence_low"]),
    8: ("-", "5 km", "Sibiu", "olt", None, "unresolved", ["limite_unusable"]),
    9: ("km 183 / km 309", "5 km", "Sibiu", "olt", (25.2, 25.264), "resolved", ["limite_unusable_overridden"]),
    10: ("Izvoare - Pod DN 7", "48 km", "Sibiu", "olt", (25.0, 25.12), "review", ["endpoint_ambiguous:to", "km_ratio_out_of_band"]),
    11: ("Izvoare - Pod DN 7 din loc. Tălmaciu", "48 km", "Sibiu", "olt", (25.0, 25.62), "resolved", []),
    12: ("Pod - limita jud. Brașov", "1,5 km", "Sibiu", "olt", (25.78, 25.8), "review", ["endpoint_ambiguous:to", "endpoint_confidence_low"]),  # any bridge within the window before the limit
    13: ("Izvoare – vărsare", "10 km", "Sibiu", None, None, "unresolved", ["course_missing"]),
    14: ("cascada Bigăr - Frontieră cu Ungaria", "60 km", "Sibiu", "olt", (25.15, 25.92), "resolved", []),
    15: ("Izvoare - conf. râul Nera", "60 km", "Sibiu", "olt", None, "unresolved", ["endpoint_unresolved:to"]),
    16: ("Județul Cluj", "39 km", "Cluj", "olt", None, "unresolved", ["county_not_on_course"]),
    17: ("Izvoare - Bradu", "41 km", "Sibiu", "olt", (25.0, 25.52), "review", ["endpoint_confidence_low"]),
    18: ("Bicaz, Zlatna, Cugir", "39 km", "Cluj", "olt", None, "unresolved", ["locality_list_unresolved"]),
    19: (None, None, None, "olt", None, "unresolved", ["contract_km_missing", "limite_unusable"]),
    20: ("Izvoare - Lacul Turnu", "33 km", "Sibiu", "olt", (25.0, 25.4), "resolved", []),
    21: ("Izvoare - DN 7", "10 km", "Sibiu", "olt", (25.0, 25.12), "resolved", []),
}


def test_limits_become_sectors(spark, world):
    rows = [(k, t, size, county, course) for k, (t, size, county, course, *_) in CASES.items()]
    waters = spark.createDataFrame(rows, "sector_id long, limits string, size string, judet string, course_id string")
    m = kernels.geodesic_measures(np.array(OLT))
    at = lambda x: float(np.interp(x, np.array(OLT)[:, 0], m))
    overrides = spark.createDataFrame([(9, "from", at(25.2)), (9, "to", at(25.264)), (8, "from", 10.0), (1, "to", at(26.0))], "sector_id long, role string, m double")
    got = {r.sector_id: r for r in dispatch.resolve_limits(waters, world, overrides).collect()}
    assert set(got) == set(CASES)
    for k, (*_, span, status, reasons) in CASES.items():
        r = got[k]
        if span and status != "unresolved":
            assert abs(r.m_from - at(span[0])) < 1 and abs(r.m_to - at(span[1])) < 1, (k, r)
        assert (r.status, r.reasons) == (status, reasons), (k, r)


def test_limits_of_no_waters(spark, world):
    waters = spark.createDataFrame([], "sector_id long, limits string, size string, judet string, course_id string")
    assert dispatch.resolve_limits(waters, world).count() == 0


@pytest.mark.parametrize(("least", "seed"), [(0.9, 1), (0.85, 2), (0.8, 3)])
def test_near_spellings_are_all_found(spark, least, seed):
    import random
    from difflib import SequenceMatcher

    r = random.Random(seed)
    base = ["".join(r.choice("abcer") for _ in range(r.randint(2, 14))) for _ in range(60)] + ["aaaaaaaaaa", "aaaaaaaaab", "ababababab"]

    def spoilt(t):
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(t))
            t = r.choice([t[:i] + t[i + 1 :], t[:i] + r.choice("abcerx") + t[i:], t[:i] + r.choice("abcer") + t[i + 1 :]]) or "a"
        return t

    wanted, names = [spoilt(t) for t in base for _ in range(3)], [spoilt(t) for t in base for _ in range(3)] + ["", None]
    d, p = spark.createDataFrame([(t,) for t in wanted], "core string"), spark.createDataFrame([(t,) for t in names], "name string")
    got = {(x.core, x.name): x.score for x in sectors_near(d, p, least).collect()}
    alike = lambda a, b: a and b and a != b and a[0] == b[0] and abs(len(a) - len(b)) <= 3 and SequenceMatcher(None, a, b).ratio() >= least
    assert set(got) == {(a, b) for a in set(wanted) for b in set(names) if alike(a, b)} and len(got) > 30
