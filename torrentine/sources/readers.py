"""Sources: JSON artifacts, typed extracts, map texts, register listings, shapefiles, cached pages and snapshots.

Every reader has a schema; files that may be absent give an empty frame of it.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())
EXTRACT = T.StructType(
    [
        T.StructField("t", T.StringType()),
        T.StructField("schema", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("nodes", T.ArrayType(T.LongType())),
        T.StructField("coords", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("coord", T.ArrayType(T.DoubleType())),
        T.StructField("tags", TAGS),
        T.StructField("members", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("role", T.StringType())]))),
        T.StructField("geometry", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)
KINDS = ("meta", "way", "node", "rel", "area")


def json_array(spark: SparkSession, path: str, schema: T.StructType, optional: bool = False) -> DataFrame:
    """A JSON array of objects, one row each; an optional file that is absent is empty."""
    try:
        return spark.read.option("multiLine", True).schema(schema).json(path)
    except AnalysisException:
        if optional:
            return spark.createDataFrame([], schema)
        raise


def artifacts(spark: SparkSession, root: str, mandatory: dict[str, T.StructType], optional: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Named artifacts of a folder as lazy frames; a missing mandatory one is an error at once."""
    found = {n: json_array(spark, f"{root}/{n}", s) for n, s in mandatory.items()}
    return found | {n: json_array(spark, f"{root}/{n}", s, optional=True) for n, s in optional.items()}


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line, plain or gzip; blank lines drop out, a malformed one is an error as it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def extract(spark: SparkSession, path: str, version: int = 1) -> dict[str, DataFrame]:
    """A typed extract by kind of record. One meta record of the right version and known kinds only, or an error."""
    rows = spark.read.schema(EXTRACT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = rows.select("t", "schema", "_corrupt", "id").where(~F.coalesce(F.col("t").isin(*KINDS), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"unknown or malformed record: {bad[0].asDict()}")
    meta = rows.where("t = 'meta'").limit(2).collect()
    if len(meta) != 1 or meta[0].schema != version:
        raise ValueError("an extract needs one meta record of its version")
    cols = {"way": ["id", "nodes", "coords", "tags"], "node": ["id", "coord", "tags"], "rel": ["id", "tags", "members"], "area": ["id", "tags", "geometry"], "meta": ["schema", "source"]}
    return {k: rows.where(F.col("t") == k).select(*c) for k, c in cols.items()}


@F.pandas_udf(T.StringType())
def unescape_opl(s: pd.Series) -> pd.Series:
    """``%hex%`` escapes as letters."""
    return s.str.replace(r"%([0-9A-Fa-f]+)%", lambda m: chr(int(m[1], 16)), regex=True)


def opl_tags(field: Column) -> Column:
    """``k=v,k2=v2`` as a map of escaped text; pairs without ``=`` drop out."""
    pairs = F.filter(F.split(F.coalesce(field, F.lit("")), ","), lambda p: p.contains("="))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.expr("''").alias("e"), F.regexp_replace(p, "^[^=]*=", "").alias("v")).dropFields("e")))


def opl(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, tags, lon, lat, refs, members) of an OPL text; deleted objects, comments and nodes without a place drop out."""
    line = spark.read.text(path).where(F.col("value").rlike("^[nwr][0-9]"))
    field = lambda c: F.nullif(F.regexp_extract("value", rf"(?:^| ){c}([^ ]*)", 1), F.lit(""))
    kind = F.substring("value", 1, 1)
    numbers = lambda c, p: F.transform(F.split(F.regexp_replace(field(c), p, ""), ","), lambda x: x.try_cast("long"))
    members = F.transform(F.filter(F.split(field("M"), ","), lambda m: m != ""), lambda m: F.struct(F.substring(m, 1, 1).alias("type"), F.regexp_extract(m, r"^.(\d+)", 1).try_cast("long").alias("ref"), F.regexp_extract(m, "@(.*)$", 1).alias("role")))
    rows = line.select(kind.alias("kind"), F.regexp_extract("value", r"^.(\d+)", 1).cast("long").alias("id"), field("T").alias("tag_text"), field("x").try_cast("double").alias("lon"), field("y").try_cast("double").alias("lat"), F.when(kind == "w", numbers("N", "n")).alias("refs"), F.when(kind == "r", members).alias("members"), F.regexp_extract("value", r" d([VD])(?: |$)", 1).alias("_d"))
    rows = rows.where("_d <> 'D' and (kind <> 'n' or (lon is not null and lat is not null))").drop("_d")
    return rows.withColumn("tag_text", unescape_opl("tag_text")).withColumn("tags", opl_tags(F.col("tag_text"))).drop("tag_text")


def geojson_seq(spark: SparkSession, path: str, keep: Callable[[Column], Column]) -> DataFrame:
    """(id, tags, kind, geometry) of polygons in a sequence with record separators, of those whose tags are kept."""
    schema = "struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    rows = spark.read.text(path).select(F.from_json(F.regexp_replace("value", "^\x1e", ""), schema).alias("f")).where("f is not null and f.geometry.type in ('Polygon', 'MultiPolygon')")
    return rows.where(keep(F.col("f.properties"))).select(F.col("f.id").alias("id"), F.col("f.properties").alias("tags"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("geometry"))


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways (id, refs) with their part, in order, from nodes (id, lon, lat); a node without a place is left out."""
    at = ways.select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "ref")).join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    parts = at.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("part"))
    return ways.join(parts, ways.id == parts.way, "left").drop("way")


def assemble_relations(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, parts, missing): parts of the member ways, in order, and how many of them are not there."""
    m = relations.select("id", F.posexplode("members").alias("pos", "m")).where("m.type in ('w', 'way')")
    hit = m.join(ways.select(F.col("id").alias("ref"), "part"), F.col("m.ref") == F.col("ref"), "left")
    present = F.coalesce(F.size("part") >= 2, F.lit(False))
    return hit.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(present, F.struct("pos", "part")))), lambda x: x["part"]).alias("parts"), F.count_if(~present).alias("missing"))


def name_index(rows: DataFrame, key: Column, value: str) -> DataFrame:
    """(key, values): all ids of a normalised name longer than three letters."""
    return rows.select(key.alias("key"), value).where(F.length("key") > 3).groupBy("key").agg(F.array_sort(F.collect_set(value)).alias("values"))


def best_geometry(rows: DataFrame, key: Column, is_relation: Column, order: str) -> DataFrame:
    """One row a name: a relation before a way, then the first."""
    w = Window.partitionBy("key").orderBy(is_relation.desc(), F.col(order))
    return rows.withColumn("key", key).where(F.length("key") > 3).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def segment_index(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Rows of relations with their members and whether each is present, then rows of ways."""
    m = relations.select("id", "name", F.posexplode("way_ids").alias("pos", "ref")).join(ways.select(F.col("id").alias("ref"), F.size("part").alias("k")), "ref", "left")
    rel = m.groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", F.coalesce(F.col("k") >= 2, F.lit(False)).alias("present")))).alias("members"))
    return rel.select(F.lit("relation").alias("kind"), "id", "name", "members").unionByName(ways.select(F.lit("way").alias("kind"), "id", "name"), allowMissingColumns=True)


def fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int]]) -> DataFrame:
    """(file, line, columns...) of a text in columns; a width of 0 runs to the end.

    Lines are numbered within a file as it is read whole by one task, since a place in a layout text only means something in order.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    cut = {n: F.trim(F.expr(f"substring(value, {a + 1}{f', {w}' if w else ''})")) for n, (a, w) in columns.items()}
    return rows.select("file", "line", *[c.alias(n) for n, c in cut.items()])


def carried(rows: DataFrame, header: Column, value: Column, name: str, partition: str = "file", order: str = "line") -> DataFrame:
    """Rows below a heading with what it says, until the next one."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(header, value), ignorenulls=True).over(w))


ROW = r"^\s*(\d+)\.?\s+(.*?\S)\s{2,}(.*?\S)(?:\s{2,}(.*?))?\s*$"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(county, section, nr, name, limits, rest) of register listings: headings of counties and sections, rows with columns two blanks apart."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    rows = carried(rows, F.col("value").rlike(r"^\s*D\.?S\.?\s+\S"), F.trim(F.regexp_extract("value", r"^\s*D\.?S\.?\s+(.*\S)", 1)), "county")
    rows = carried(rows, F.lower("value").rlike(r"^\s*(?:ape curgatoare|rauri|lacuri)"), F.when(F.lower("value").rlike("lac"), "lake").otherwise("river"), "section")
    part = lambda i: F.nullif(F.regexp_extract("value", ROW, i), F.lit(""))
    return rows.where(F.col("value").rlike(ROW)).select("county", "section", part(1).cast("int").alias("nr"), part(2).alias("name"), part(3).alias("limits"), part(4).alias("rest"))


def read_shapes(data: bytes) -> list[tuple[int, list[list[tuple[float, float]]]]]:
    """(record number, parts) of polylines, polygons and points in the bytes of a .shp file."""
    out, at = [], 100
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind == 1:
            out.append((number, [[struct.unpack_from("<2d", data, at + 12)]]))
        elif kind in (3, 5):
            n_parts, n_points = struct.unpack_from("<ii", data, at + 44)
            starts = [*struct.unpack_from(f"<{n_parts}i", data, at + 52), n_points]
            xy = struct.unpack_from(f"<{2 * n_points}d", data, at + 52 + 4 * n_parts)
            points = list(zip(xy[::2], xy[1::2]))
            out.append((number, [points[a:b] for a, b in zip(starts, starts[1:])]))
        at += 8 + 2 * words
    return out


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, parts) of shapes; a file is one task."""
    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(file, n, [[{"lon": x, "lat": y} for x, y in p] for p in parts]) for n, parts in read_shapes(data)]
                point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.list_(point))))], names=["file", "number", "parts"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, number long, parts array<array<struct<lon:double,lat:double>>>")


HASHED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string())])


def file_hashes(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """(path, length, sha256) of each file below a folder, or of one file, for manifests and their comparison.

    Empty files are listed too; names that begin with a dot or an underscore are not, as in Spark's own readers. The listing goes through the
    driver, a row a file; executors read a file of any size in chunks. Both open the place with ``pyarrow.fs``. A missing place gives no rows.
    """
    uri = path if "://" in path or path.startswith("file:") else os.path.abspath(path)

    def opened() -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else "file://" + uri[5:])

    fs, root = opened()
    one = fs.get_file_info(root)
    found = [one] if one.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = lambda x: not any(part[0] in "._" for part in x.path[len(root) :].split("/") if part)
    files = sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and shown(x))

    def hashed(batches):
        fs, _ = opened()
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                sha, n = hashlib.sha256(), 0
                with fs.open_input_stream(name) as stream:
                    while data := stream.read(chunk):
                        sha.update(data)
                        n += len(data)
                out.append((name, n, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ((), (), ()), HASHED)], schema=HASHED)

    listed = spark.createDataFrame(files, "path string, length long")
    return listed.repartition(max(1, min(len(files), 10_000))).mapInArrow(hashed, "path string, length long, sha256 string")


def pages_by_skip(fetch: Callable[[int], tuple[list[dict], int | None]], key: str = "id", most: int = 100_000) -> list[dict]:
    """All records of a paged service: the next page starts after as many as came, repeats once; ends on an empty page, the total or a run-away."""
    seen: dict = {}
    skip = 0
    while skip < most:
        rows, total = fetch(skip)
        for r in rows:
            seen.setdefault(r[key], r)
        skip += len(rows)
        if not rows or total is not None and skip >= total:
            return list(seen.values())
    raise RuntimeError("the service does not end")


class _Labels(HTMLParser):
    """Texts after labels that end in a colon."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("p", "div", "li", "tr", "td", "dt", "dd", "br", "h1", "h2", "h3"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in ("p", "div", "li", "tr", "td", "dt", "dd", "h1", "h2", "h3"):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def labelled(page: str | None, labels: dict[str, list[str]]) -> dict[str, str | None]:
    p = _Labels()
    p.feed(page or "")
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.parts).split("\n")]
    lines = [x for x in lines if x]
    out: dict[str, str | None] = dict.fromkeys(labels)
    for i, line in enumerate(lines):
        head, colon, rest = line.partition(":")
        for name, words in labels.items():
            if colon and out[name] is None and head.strip().lower() in words:
                out[name] = rest.strip() or (lines[i + 1] if i + 1 < len(lines) and ":" not in lines[i + 1] else None)
    return out


def html_records(pages: DataFrame, html: str, labels: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """The kept columns with one column a label, read from pages."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in labels])

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([labelled(x, labels) for x in s], columns=list(labels))

    return pages.select(*keep, run(html).alias("_r")).select(*keep, "_r.*")


class Registry:
    """Sources by name; one that lacks a name or fails to load is told and skipped."""

    def __init__(self):
        self.sources: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self.warnings: list[str] = []

    def add(self, module) -> None:
        name, collect = getattr(module, "name", None), getattr(module, "collect", None)
        if isinstance(name, str) and callable(collect):
            self.sources[name] = collect
        else:
            self.warnings.append(f"{module!r} exports no name and collect")

    def collect(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {n: c(spark) for n, c in sorted(self.sources.items())}


def cached(queries: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(answers, misses): queries with a cached row, negative ones included, and those without."""
    return queries.join(cache, key), queries.join(cache, key, "left_anti")


def snapshot(spark: SparkSession, place: str, version: int, names: list[str]) -> dict[str, DataFrame] | None:
    """All tables of a snapshot, or nothing if it is not whole or of another version."""
    try:
        mark = spark.read.parquet(f"{place}/_complete").first()
        if mark is None or mark["version"] != version or set(names) - set(mark["names"].split(",")):
            return None
        return {n: spark.read.parquet(f"{place}/{n}") for n in names}
    except AnalysisException:
        return None
