"""Queries on tables with the keys of larger ones, against their SQL in DuckDB."""

import time

import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_queries import rows
from torrentine.functions import kernels
from torrentine.operators import joins, repairs
from torrentine.plans import registry

SF = "/root/testdata/sf0.1"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL; a table is a SELECT over sf0.1."""
    con = duckdb.connect()
    for t, select in tables.items():
        con.execute(f"copy ({select}) to '{folder}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df, want = QUERIES[name](spark, str(folder)), con.execute(SQL[name])
    return rows(df.columns, df.collect()), rows([d[0] for d in want.description], want.fetchall())


def of(table, where="true"):
    return f"select * from '{SF}/{table}.parquet' where {where}"


def test_flow_edges_of_ways_of_several_users(spark, tmp_path):
    """Way 100 has events of user 0 from number 100 000 on and of user 1 up to 1000."""
    events = f"select * replace (case when user_id = 0 then event_id % 1000 + 100000 else event_id % 1000 end as event_id, user_id % 2 as user_id) from ({of('events', 'event_id < 40000 and user_id < 2')})"
    got, want = both(spark, tmp_path, "flow_edges", events=events)
    assert got == want and any(r[1] > 1 for r in got)


def test_near_join_at_its_limit(spark, tmp_path):
    """A pair 5000 metres and a bit apart, 5000 when rounded, which is what SQL compares."""
    got, want = both(spark, tmp_path, "near_join", supplier=of("supplier", "s_suppkey = 180"), customer=of("customer", "c_custkey in (1127, 7)"), nation=of("nation"))
    assert got == want and len(got) == 1


def keyed(table, column, keys, shift):
    """Rows of sf0.1 under larger keys."""
    return " union all ".join(f"select * replace ({k}::bigint as {column}) from ({of(table, f'{column} = {k % shift}')})" for k in keys)


def test_lake_intervals_where_a_cut_is_missed(spark, tmp_path):
    """Courses through a corner of a lake at which the cut is missed: the place at the middle of what is left tells, in SQL and in Spark."""
    suppliers, waters = keyed("supplier", "s_suppkey", (5626, 5597, 5186, 5901), 1000), keyed("customer", "c_custkey", (13204, 49879, 54164, 13429), 15000)
    got, want = both(spark, tmp_path, "lake_intervals", supplier=suppliers, customer=waters, nation=of("nation"))
    assert got == want and len(got) >= 4


def most_rows(df):
    """The most rows that an operator of the query gives out."""
    df.collect()

    def walk(node):
        for inner in ("executedPlan", "plan", "child"):  # adaptive plans and their stages keep theirs apart
            if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec") and inner != "child":
                try:
                    return walk(getattr(node, inner)())
                except Exception:  # noqa: BLE001
                    continue
        rows_ = node.metrics().get("numOutputRows")
        mine = rows_.get().value() if rows_.isDefined() else 0
        children = node.children()
        return max([mine, *[walk(children.apply(i)) for i in range(children.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_tiered_match_makes_no_pairs_of_a_key(spark):
    n = 2000
    left = spark.range(n).selectExpr("id", "'k' as key", "id % 7 as k7")
    tiers = [joins.keyed_tier(left, "id", "key", spark.range(n).selectExpr("id as o", "'none' as k"), "o", "k"), joins.keyed_tier(left, "id", "k7", spark.range(n).selectExpr("id as o", "id % 5 + 3 * (id div 5) as k"), "o", "k")]
    many = joins.keyed_tier(left, "id", "key", spark.range(n).selectExpr("id as o", "'k' as k"), "o", "k")
    out = joins.tiered_match(left, "id", [tiers[0], tiers[1], many])
    got = {(r.id % 7, r.match, r.tier, r.status) for r in out.collect()}
    count = {k: [o for o in range(n) if o % 5 + 3 * (o // 5) == k] for k in range(7)}
    assert got == {(k, c[0] if len(c) == 1 else None, 2, "matched" if len(c) == 1 else "ambiguous") for k, c in count.items()}
    assert most_rows(out) <= 6 * n


def test_tiered_match_query_makes_no_pairs_of_a_key(spark, tmp_path):
    """All waters in one group: 2000 on the left, some hundred on the right."""
    customers = f"select * replace (c_custkey * 140 * 90 as c_custkey) from ({of('customer', 'c_custkey < 2000')})"
    got, want = both(spark, tmp_path, "tiered_match", customer=customers, nation=of("nation"))
    assert got == want
    assert most_rows(QUERIES["tiered_match"](spark, str(tmp_path))) <= 6000


def test_contract_at_asks_equal_places_and_intervals_once(spark, tmp_path):
    """Clicks on one river at one place, and contracts with one interval."""
    customers = f"select * replace (c_custkey * 140 * 800 + 1 as c_custkey) from ({of('customer', 'c_custkey < 500')})"
    orders = f"select * replace (o_orderkey * 150 * 997 + 1 as o_orderkey) from ({of('orders', 'o_orderkey < 2000')})"
    got, want = both(spark, tmp_path, "contract_at_click", customer=customers, nation=of("nation"), orders=orders)
    assert got == want
    assert most_rows(QUERIES["contract_at_click"](spark, str(tmp_path))) <= 4000


def test_same_body_compares_neighbours(spark, tmp_path):
    """Waters of one kind and county: boxes are compared within cells; those without a box go with every one that has."""
    customers = f"select * replace (c_custkey * 3 as c_custkey, 1 as c_nationkey) from ({of('customer', 'c_custkey < 1500')})"
    got, want = both(spark, tmp_path, "same_body", customer=customers, nation=of("nation"))
    assert got == want and len(got) > 100_000  # of 88 without a box
    boxed = f"{customers} where c_custkey % 17 > 0"
    got, want = both(spark, tmp_path, "same_body", customer=boxed, nation=of("nation"))
    assert got == want and len(got) > 10
    assert most_rows(QUERIES["same_body"](spark, str(tmp_path))) <= 30_000


def test_reservoir_courses_of_far_keys(spark, tmp_path):
    """Customers 400 000 apart: each has its own lake only."""
    keys = [k + i * 400_000 for k in range(40, 72) for i in (0, 1, 2, 13)]
    got, want = both(spark, tmp_path, "reservoir_courses", customer=keyed("customer", "c_custkey", keys, 15000), nation=of("nation"))
    assert got == want and len(got) > 120


def test_distances_of_lines_without_a_call_a_place():
    """Many points against many lines in a second; equal lines are known at once."""
    rnd = np.random.default_rng(5)
    lines = [np.round(rnd.random((67, 2)) * [0.02, 0.01], 4) for _ in range(40)]
    lines[3][20] = lines[3][19]  # a step of no length
    started = time.perf_counter()
    near = [[kernels.near_line(kernels.sampled(a), b, 0.0008) for b in lines] for a in lines]
    for a, row in zip(lines[:8], near):
        for b, got in zip(lines[:8], row):
            assert got.tolist() == [kernels._project(b, *x)[0] <= 0.0008 for x in kernels.sampled(a)]
    far = [kernels.hausdorff_m(a * 20, a * 20) for a in lines]
    assert far == [0.0] * 40 and time.perf_counter() - started < 3
    a, b = lines[0] * 5, lines[1] * 5
    p, q = kernels.resample(a, 50.0), kernels.resample(b, 50.0)
    d = kernels._pairwise_m(p, q)
    assert abs(kernels.hausdorff_m(a, b) - max(d.min(axis=0).max(), d.min(axis=1).max())) < 1e-9


def test_near_share_of_empty_and_missing_lines(spark):
    line = "array<struct<lon:double,lat:double>>"
    rows_ = spark.createDataFrame([(0, [(0.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 0.0)]), (1, None, [(0.0, 0.0), (1.0, 0.0)]), (2, [], [(0.0, 0.0), (1.0, 0.0)]), (3, [(0.0, 0.0)], [(0.0, 0.0)]), (4, [(0.5, 0.0), (0.5, 9.0)], [(0.0, 0.0), (1.0, 0.0)])], f"id int, a {line}, b {line}")
    got = {r.id: tuple(r.s) for r in rows_.select("id", repairs.near_share("a", "b", F.lit(0.001)).alias("s")).collect()}
    assert got == {0: (1.0, True), 1: (0.0, False), 2: (0.0, False), 3: (0.0, False), 4: (0.5, False)}


def test_match_lakes_scores_names_once(spark):
    """Many waters of few names; a water whose best name is far takes the next one that is near."""
    from difflib import SequenceMatcher

    rnd = np.random.default_rng(2)
    names = ["apa mare", "apa mare de sus", "apa mica", "balta", "balta alba", "balti", "apa mara"]
    w = [(i, names[i % 7], float(x), float(y)) for i, (x, y) in enumerate(rnd.random((120, 2)) * [0.9, 0.6] + [24, 45])]
    lakes = [(i, names[int(k)], float(x), float(y), bool(i % 3 == 0), float(i % 4)) for i, (x, y, k) in enumerate(rnd.random((60, 3)) * [0.9, 0.6, 7] + [24, 45, 0])]
    a, b = spark.createDataFrame(w, "id int, name_key string, lon double, lat double"), spark.createDataFrame(lakes, "lake int, name_key string, lon double, lat double, is_dam boolean, area_ha double")

    def score(x, y):
        p, q = set(x.split()), set(y.split())
        words, letters = len(p & q) / max(len(p), len(q)), SequenceMatcher(None, x, y).ratio()
        return max([s for s in (words * (words >= 0.6), letters * (letters >= 0.8 and x.split()[0] == y.split()[0])) if s] or [0])

    want = {}
    for i, n, x, y in w:
        rank = [(score(n, m), not dam, -km, area, k) for k, m, u, v, dam, area in lakes if score(n, m) and (km := kernels.measures(np.array([(x, y), (u, v)]))[-1] / 1000) <= 12]
        if rank:
            want[i] = max(rank)[-1]
    got = repairs.match_lakes(a, b, "id", "lake")
    assert {r.id: r.lake for r in got.collect()} == want and len(want) > 60
    assert any(score(n, lakes[want[i]][1]) < max(score(n, m[1]) for m in lakes) for i, n, *_ in w if i in want)
    scores = repairs.name_scores(a, b)
    assert most_rows(scores) < 1000 and scores.count() == sum(score(x, y) > 0 for x in names for y in {m[1] for m in lakes})


def test_bridge_crossings_broadcast_no_dealt_rows(spark):
    """Small files of roads and courses are many rows once dealt to cells; their join must not go through the driver."""
    plan = QUERIES["bridge_crossings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
