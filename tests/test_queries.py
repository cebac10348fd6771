"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import decimal
import glob
import math
import os
import re
import unicodedata

import duckdb
import pytest

from torrentine.operators import network
from torrentine.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None:
        return None
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 9) if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_distances_and_similarities_of_waters(spark):
    """geodesics against the sphere, on which they differ by half a percent at most; name_similarity letter by letter."""
    from difflib import SequenceMatcher

    from torrentine.plans.fixtures import waters

    w = {r.slug: r for r in waters(spark, SF).collect()}
    far = QUERIES["geodesics"](spark, SF).collect()
    assert len(far) == len(w)
    for r in far:
        lat1, lat2, dlon = math.radians(45), math.radians(w[r.slug].lat), math.radians(w[r.slug].lon - 25)
        h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(dlon / 2) ** 2
        assert abs(r.m - 2 * 6371000 * math.asin(math.sqrt(h))) <= 0.006 * r.m + 1
    before, want = {}, {}
    for r in sorted(w.values(), key=lambda r: r.ord):
        if r.river_group in before:
            want[r.slug] = round(SequenceMatcher(None, r.name, before[r.river_group]).ratio(), 6)
        before[r.river_group] = r.name
    assert {r.slug: r.ratio for r in QUERIES["name_similarity"](spark, SF).collect()} == want


def stripped(t):
    """Lower case without the marks of Latin letters that decompose to one ASCII letter, and without loose marks."""
    out = []
    for c in t.lower():
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        latin = 0xC0 <= ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00
        out.append(plain if latin and len(plain) == 1 and plain.isascii() else "" if unicodedata.category(c).startswith("M") else c)
    return "".join(out)


def test_texts_are_folded_whole(spark, tmp_path):
    texts = ["Straße für Übung, größer", "El niño comió", "ÉCOLE « où »", "x " * 60 + "Ende_ÄÖÜ - fin", None, "", "\u0219coal\u0103 a\u0301", "Über\nab", "uber", "niño y", "NINO"]
    lang = ["de", "es", "fr", "de", "en", "de", "ro", "de", "en", "es", None]
    spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, lang))], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.folded, r.slug) for r in QUERIES["folded_texts"](spark, str(tmp_path)).collect()}
    fold = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s-]|_", " ", stripped(t))).strip()
    slug = lambda t: re.sub("[^a-z0-9]+", "-", stripped(t)).strip("-")
    assert got == {i: (fold(t or ""), slug(t or "")) for i, t in enumerate(texts)} and got[3][0].endswith("ende aou - fin")
    first = {}
    for t in texts:
        w = (t or "").split(" ")[0].split("\n")[0]
        if stripped(w.strip(" ")):
            first.setdefault(stripped(w.strip(" ")), w)
    assert {r.key: r.w for r in QUERIES["first_spelling"](spark, str(tmp_path)).collect()} == first and {"uber", "nino"} <= set(first)


def test_components_of_every_edge(spark, tmp_path):
    keys = [*range(1, 61), *range(70, 75), 7, 7, 200, None]
    spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for k in filter(None, keys):
        for v in (k + 1, k * 7 % 100 + 20000):
            a, b = find(k), find(v)
            top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in top} and got[61] == 1


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(2000)]
    assert dict(map(tuple, network.components(spark.createDataFrame(edges, "u long, v long")).collect())) == dict.fromkeys(range(2001), 0)


def test_entry(spark):
    assert registry.entry(spark).count() > 0
