"""The river network as tables: ways to edges, components, courses, junctions, cadastral parents."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torrentine.functions.kernels import from_part, geodesic_lengths, to_part
from torrentine.functions.text import parent_code
from torrentine.operators import chains
from torrentine.operators.linear import area_edges, ends_in_areas
from torrentine.sources.scratch import checkpointed, dealt


@F.pandas_udf(T.DoubleType())
def line_m(part: pd.Series) -> pd.Series:
    """Length on WGS84 in metres, the measure of courses, for a batch of lines at once."""
    return pd.Series(geodesic_lengths([to_part(p) for p in part]), dtype="float64")


def flow_edges(ways: DataFrame) -> DataFrame:
    """(way_id, seq, key, u, v, part, length_m): ways (way_id, nodes, part) cut at their ends and at nodes of two ways or more."""
    member = ways.select("way_id", F.explode(F.array_distinct("nodes")).alias("node"))
    junctions = member.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("node")
    at = ways.select("way_id", F.size("nodes").alias("k"), F.posexplode("nodes").alias("pos", "node"))
    inner = at.where("pos > 0 and pos < k - 1").join(junctions, "node").groupBy("way_id").agg(F.collect_set("pos").alias("cuts"))
    both = ways.join(inner, "way_id", "left").where(F.size("nodes") >= 2)
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.size("nodes") - 1), F.coalesce("cuts", F.array().cast("array<int>")))))
    rows = both.withColumn("cuts", cuts).select("way_id", "nodes", "part", "cuts", F.posexplode(F.slice("cuts", 1, F.size("cuts") - 1)).alias("seq", "a"))
    b = F.get("cuts", F.col("seq") + 1)
    part = F.slice("part", F.col("a") + 1, b - F.col("a") + 1)
    key = F.concat_ws(":", F.col("way_id").cast("string"), F.col("seq").cast("string"))
    out = rows.select("way_id", "seq", key.alias("key"), F.get("nodes", F.col("a")).alias("u"), F.get("nodes", b).alias("v"), part.alias("part"))
    return out.withColumn("length_m", F.round(line_m("part"), 3))


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 40) -> DataFrame:
    """(node, component), component being the least node reachable, by least labels and pointer jumping.

    A node takes the least label of itself and its neighbours, then the label of its label; rounds are checkpointed and end
    when no label moves.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    both = checkpointed(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        jump = low.select(F.col("node").alias("j"), F.col("low").alias("to"))
        nxt = low.join(jump, low.low == jump.j, "left").select("node", "label", F.least("low", F.coalesce("to", "low")).alias("new"))
        nxt = checkpointed(nxt)
        moved = nxt.where("new <> label").limit(1).count()
        labels = nxt.select("node", F.col("new").alias("label"))
        if not moved:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


class Edge(NamedTuple):
    u: int
    v: int
    key: str
    part: list
    length_m: float


POINTS = "array<struct<lon:double,lat:double>>"
COURSE = f"course_id string, length_m double, nodes array<bigint>, keys array<string>, part {POINTS}, synthetic array<struct<m_from:double,m_to:double,kind:string>>, qa array<string>"
PATH = f"path int, nodes array<bigint>, keys array<string>, part {POINTS}, notes array<string>"
LINE_ARROW = pa.list_(pa.struct({"lon": pa.float64(), "lat": pa.float64()}))
COURSE_ARROW = {
    "course_id": pa.string(), "length_m": pa.float64(), "nodes": pa.list_(pa.int64()), "keys": pa.list_(pa.string()), "part": LINE_ARROW,
    "synthetic": pa.list_(pa.struct({"m_from": pa.float64(), "m_to": pa.float64(), "kind": pa.string()})), "qa": pa.list_(pa.string()),
}
PATH_ARROW = {"path": pa.int32(), "nodes": pa.list_(pa.int64()), "keys": pa.list_(pa.string()), "part": LINE_ARROW, "notes": pa.list_(pa.string())}


def _rows(name, kind, rows: list[tuple], columns: dict) -> pa.Table:
    cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(columns), columns.values())]
    return pa.table([pa.array([name] * len(rows), kind), *cols], names=["group_key", *columns])


def component_paths(edges: DataFrame, group: str) -> DataFrame:
    """(group_key, path, nodes, keys, part, notes): the longest path of each component of each group of edges, with its line.

    Groups are names of rivers, so one is small; it is read in one task.
    """
    kind = dict(edges.dtypes)[group]

    def build(t: pa.Table) -> pa.Table:
        edge = {r["key"]: Edge(**r) for r in t.drop_columns(group).to_pylist()}
        top = {n: n for r in edge.values() for n in (r.u, r.v)}

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for r in edge.values():
            a, b = find(r.u), find(r.v)
            top[max(a, b)] = min(a, b)
        comps: dict[int, list] = {}
        for r in sorted(edge.values(), key=lambda r: (r.u, r.v, r.key)):
            comps.setdefault(find(r.u), []).append((r.u, r.v, r.key, r.length_m))
        paths = [p for _, es in sorted(comps.items()) if (p := chains.longest_path(es))]
        lines = [chains.assemble([to_part(edge[k].part) for k in p["keys"]], [""] * len(p["keys"]))[0] for p in paths]
        rows = [(i, p["nodes"], p["keys"], from_part(line), sorted(p["notes"])) for i, (p, line) in enumerate(zip(paths, lines))]
        return _rows(t.column(0)[0].as_py(), t.schema.field(0).type, rows, PATH_ARROW)

    return dealt(edges.select(group, "u", "v", "key", "part", "length_m"), group).groupBy(group).applyInArrow(build, f"group_key {kind}, {PATH}")


def reservoirs_at_ends(paths: DataFrame, reservoirs: DataFrame, near_m: float = 50.0) -> DataFrame:
    """The paths with first_in and last_in, the reservoirs (area, rings) that hold their first and last points or lie within ``near_m`` of them."""
    point = lambda end, i: F.struct(F.lit(end).alias("end"), F.element_at("part", i)["lon"].alias("lon"), F.element_at("part", i)["lat"].alias("lat"))
    ends = paths.select("group_key", "path", F.explode(F.array(point("first", 1), point("last", -1))).alias("p")).select(F.struct("group_key", "path", "p.end").alias("id"), "p.lon", "p.lat")
    held = ends_in_areas(ends, area_edges(reservoirs, "area"), near_m).select("id.*", "area")
    for end in ("first", "last"):
        of = held.where(F.col("end") == end).groupBy("group_key", "path").agg(F.array_sort(F.collect_set("area")).alias(f"{end}_in"))
        paths = paths.join(of, ["group_key", "path"], "left")
    return paths


def build_courses(edges: DataFrame, group: str, bridge_m: float = 250.0, across_m: float = 5000.0, reservoirs: DataFrame | None = None) -> DataFrame:
    """Courses of each group of edges: the longest path of each component, chained over gaps of up to ``bridge_m``.

    A gap of up to ``across_m`` is closed where one of the ``reservoirs`` (area, rings) lies at both of its ends; without reservoirs
    such gaps stay. The paths of a name are chained in one task.
    """
    kind = dict(edges.dtypes)[group]
    paths, across = component_paths(edges, group), reservoirs is not None
    if across:
        paths = reservoirs_at_ends(checkpointed(paths), reservoirs)

    def chain(t: pa.Table) -> pa.Table:
        paths = sorted(t.to_pylist(), key=lambda r: r["path"])
        lines = [to_part(p["part"]) for p in paths]
        held = [(set(p.get("first_in") or ()), set(p.get("last_in") or ())) for p in paths]
        shares = (lambda i, j: bool(held[i][1] & held[j][0])) if across else None
        joined = chains.chain_gaps([(tuple(x[0]), tuple(x[-1])) for x in lines], bridge_m, across_m, shares)
        built = [chains.assemble([lines[i] for i, _, _ in c], [k for _, _, k in c]) for c in joined]
        name, out = paths[0]["group_key"], []
        for chain, (line, spans), length in zip(joined, built, geodesic_lengths([x for x, _ in built])):
            ids = [i for i, _, _ in chain]
            keys, nodes = [k for i in ids for k in paths[i]["keys"]], [n for i in ids for n in paths[i]["nodes"]]
            out.append((f"{name}:{nodes[0]}", float(length), nodes, keys, from_part(line), spans, sorted({q for i in ids for q in paths[i]["notes"]})))
        return _rows(name, t.schema.field(0).type, out, COURSE_ARROW)

    return dealt(paths, "group_key").groupBy("group_key").applyInArrow(chain, f"group_key {kind}, {COURSE}")


def merge_partial(edges: DataFrame, name: str = "name_key", strong: str = "wikidata") -> DataFrame:
    """group: the strong key; an edge without one takes that of its name if the name has exactly one."""
    single = edges.where(F.coalesce(strong, F.lit("")) != "").groupBy(name).agg(F.count_distinct(strong).alias("n"), F.min(strong).alias("only")).where("n = 1").select(F.col(name).alias("nk"), "only")
    out = edges.join(single, edges[name] == single.nk, "left")
    return out.withColumn("group", F.coalesce(F.nullif(F.col(strong), F.lit("")), "only", name)).drop("nk", "only")


def link_courses(courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(course_id, receives_into): the least other course through the outlet's node; and junctions (course_id, node, tributary)."""
    at = courses.select("course_id", F.explode(F.array_distinct("nodes")).alias("node"))
    outlet = courses.select(F.col("course_id").alias("tributary"), F.element_at("nodes", -1).alias("node"))
    meets = outlet.join(at, "node").where("course_id <> tributary")
    into = meets.groupBy("tributary").agg(F.min("course_id").alias("receives_into")).withColumnRenamed("tributary", "course_id")
    last = courses.select(F.col("course_id").alias("c"), F.element_at("nodes", -1).alias("end"))
    inner = meets.join(last, meets.course_id == last.c).where("node <> end").select("course_id", "node", "tributary")
    return courses.select("course_id").join(into, "course_id", "left"), inner


def cadastre_parents(rows: DataFrame, code: str) -> DataFrame:
    """(code, parent): the parent by code, if it is there."""
    known = rows.select(F.col(code).alias("parent")).distinct()
    up = rows.select(code, parent_code(F.col(code)).alias("up"))
    return up.join(known, F.col("up") == F.col("parent"), "left").select(code, "parent")


def qa_summary(courses: DataFrame) -> DataFrame:
    return courses.agg(F.count(F.lit(1)).alias("n_courses"), F.round(F.sum("length_m") / 1000, 3).alias("km"), F.count_if(F.size("synthetic") > 0).alias("with_gaps"), F.count_if(F.array_contains("qa", "cycle_broken")).alias("cycles"), F.max("length_m").alias("longest_m"))


def per_group(rows: DataFrame, group: str, order: str, fn, schema: str) -> DataFrame:
    """``fn`` of a group's parts (rows with column part) in order; it returns rows of ``schema`` without the group."""
    kind = dict(rows.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = [(pdf[group].iloc[0], *r) for r in fn([to_part(p) for p in pdf["part"]])]
        return pd.DataFrame(out, columns=[group, *[c.split()[0] for c in schema.split(", ")]])

    return dealt(rows.select(group, order, "part"), group).groupBy(group).applyInPandas(run, f"`{group}` {kind}, {schema}")


PART = "part array<struct<lon:double,lat:double>>"


def clustered(rows: DataFrame, group: str, order: str, gap: float = 0.06) -> DataFrame:
    """(group, cluster, size) of greedy clusters of parts."""
    return per_group(rows, group, order, lambda ps: [(i, len(m)) for i, m in enumerate(chains.cluster(ps, gap))], "cluster int, size int")


def grown(rows: DataFrame, group: str, order: str, tol: float) -> DataFrame:
    """(group, used, part): the tolerant chain of parts; side branches stay out."""
    def run(ps):
        line, used = chains.grow(ps, tol)
        return [(len(used), from_part(line))]

    return per_group(rows, group, order, run, f"used int, {PART}")


def strict(rows: DataFrame, group: str, order: str) -> DataFrame:
    def run(ps):
        line = chains.strict_chain(ps)
        return [(None if line is None else from_part(line),)]

    return per_group(rows, group, order, run, PART)


def rings(rows: DataFrame, group: str, order: str) -> DataFrame:
    def run(ps):
        line = chains.ring(ps)
        return [(None if line is None else from_part(line),)]

    return per_group(rows, group, order, run, PART)
