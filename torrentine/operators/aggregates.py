"""Aggregations, distinct sets, deduplication and audit rules. Every pick has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(parents: DataFrame, rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Parents with how many rows they have; none is zero."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def sorted_set(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def distinct_sorted(pools: list[DataFrame], column: str, collation: str | None = "ro") -> DataFrame:
    """Distinct values over pools, in the order of a language."""
    rows = pools[0].select(column)
    for p in pools[1:]:
        rows = rows.union(p.select(column))
    rows = rows.where(F.col(column).isNotNull()).distinct()
    return rows.orderBy(F.collate(F.col(column), collation) if collation else F.col(column))


def first_spelling(rows: DataFrame, key: Column, display: str, order: str) -> DataFrame:
    """(key, display): the first spelling of each key; empty keys drop out."""
    return rows.select(key.alias("key"), display, order).where("key <> ''").groupBy("key").agg(F.min_by(display, order).alias(display))


def counts_where(rows: DataFrame, key: Column, cond: Column) -> DataFrame:
    return rows.where(cond).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("key <> ''")


def centroids(rows: DataFrame, key: str, lon: Column, lat: Column) -> DataFrame:
    return rows.select(key, lon.alias("lon"), lat.alias("lat")).where("lon is not null and lat is not null").groupBy(key).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def coverage_rollup(rows: DataFrame, key: str, done: Column, total_name: str = "_overall") -> DataFrame:
    """(key, resolved, total, pct) per key and over all."""
    r = rows.select(key, F.coalesce(done, F.lit(False)).alias("done")).rollup(key).agg(F.count_if("done").alias("resolved"), F.count(F.lit(1)).alias("total"), F.grouping(key).alias("g"))
    return r.select(F.when(F.col("g") == 1, F.lit(total_name)).otherwise(F.col(key)).alias(key), "resolved", "total", F.round(100.0 * F.col("resolved") / F.col("total"), 2).alias("pct"))


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bucket, n): counts below each edge and beyond the last; null is its own bucket."""
    b = F.when(value.isNull(), "null")
    for e in edges:
        b = b.when(value < e, f"<{e:g}")
    return rows.select(b.otherwise(f">={edges[-1]:g}").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def progress(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts over several groupings at once; a column outside its grouping is null, ``level`` tells them apart."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*cols).cast("long").alias("level"))


def cross_tab(rows: DataFrame, key: str, measures: dict[str, Column], status: Column) -> DataFrame:
    """Per key the number of rows for which each measure holds, and a status derived from them."""
    out = rows.groupBy(key).agg(*[F.count_if(F.coalesce(m, F.lit(False))).alias(n) for n, m in measures.items()])
    return out.withColumn("status", status)


def code_counts(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(key, codes): a map from code to count."""
    n = rows.groupBy(key, code).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "n")))).alias("codes"))


def totals(rows: DataFrame, sums: dict[str, Column], counts: dict[str, Column], distincts: dict[str, str]) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(c), 3).alias(k) for k, c in sums.items()],
        *[F.count_if(c).alias(k) for k, c in counts.items()],
        *[F.count_distinct(c).alias(k) for k, c in distincts.items()],
    )


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value; of equals the smallest."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(value))).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), (-F.col("b.neg")).alias("n"))


def duplicates(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drift(declared: DataFrame, recomputed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, declared, actual) where a stored value is not the computed one; a missing side counts."""
    b = recomputed.select(key, *[F.col(c).alias(f"{c}__now") for c in columns])
    both = declared.select(key, *columns).join(b, key, "full")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("declared"), F.col(f"{c}__now").cast("string").alias("actual"), F.col(c).eqNullSafe(F.col(f"{c}__now")).alias("same")) for c in columns]))
    return both.select(key, rows.alias("r")).where("not r.same").select(key, "r.field", "r.declared", "r.actual")


def keep_largest(rows: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """The largest row of each key; of equals the first."""
    w = Window.partitionBy(key).orderBy(F.col(size).desc_nulls_last(), F.col(order))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def suffix_duplicates(rows: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """All rows; of one key the largest keeps it, the others get -2, -3, ..."""
    w = Window.partitionBy(key).orderBy(F.col(size).desc_nulls_last(), F.col(order))
    return rows.withColumn("rn", F.row_number().over(w)).withColumn(key, F.when(F.col("rn") == 1, F.col(key)).otherwise(F.concat_ws("-", key, F.col("rn").cast("string")))).drop("rn")


def first_by(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of each composite key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rn = 1").drop("rn")


def merge_sets(rows: DataFrame, keys: list[str], sets: list[str], same: str) -> DataFrame:
    """One row a key with united sets; conflict is true if ``same`` differs among its rows."""
    return rows.groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(s)))).alias(s) for s in sets], (F.count_distinct(same) > 1).alias("conflict"))


def group_switch(rows: DataFrame, group: str, ok: Column, own: Column) -> DataFrame:
    """switch, partial or blocked: a group goes together; else a member with something of its own may stay out while others go."""
    w = Window.partitionBy(group)
    every = F.every(F.coalesce(ok, F.lit(False))).over(w)
    return rows.withColumn("action", F.when(every, "switch").when(F.coalesce(ok & ~own, F.lit(False)), "partial").otherwise("blocked"))


def switched_groups(rows: DataFrame, group: str, is_sector: Column, course: str) -> DataFrame:
    """(group, course) of groups of two or more, all sectors, on exactly one course."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce(is_sector, F.lit(False))).alias("all"), F.count_distinct(course).alias("c"), F.min(course).alias(course))
    return g.where("n >= 2 and all and c = 1").select(group, course)


def longest(rows: DataFrame, keys: list[Column], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(value).alias(value))


def bbox_union(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def cells(rows: DataFrame, item: str, cell_deg: float = 0.5) -> DataFrame:
    """(item, cx, cy): cells that the box of an item covers."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell_deg).cast("long"), F.floor(F.col(hi) / cell_deg).cast("long"))
    return rows.where("min_lon <= max_lon and min_lat <= max_lat").select(item, F.explode(span("min_lon", "max_lon")).alias("cx"), span("min_lat", "max_lat").alias("ys")).select(item, "cx", F.explode("ys").alias("cy")).distinct()


def report(rules: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(rule, severity, key): results of rules, each a frame with column key, below each other."""
    rows = None
    for name, (severity, d) in rules.items():
        d = d.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col("key").cast("string").alias("key"))
        rows = d if rows is None else rows.unionByName(d)
    return rows
