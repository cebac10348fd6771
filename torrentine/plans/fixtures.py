"""Domain tables derived from the driver's tables, as expressions that Spark and DuckDB read alike.

customers are waters in counties (nations), line items contracts on courses (orders), events positions of users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "c_custkey"
WATER = {
    "slug": f"concat('w-', CAST({K} AS STRING))",
    "ord": K,
    "name": f"concat(CASE WHEN {K} % 7 = 0 THEN 'Valea ' WHEN {K} % 7 = 1 THEN 'Raul ' ELSE '' END, 'Apa ', CAST({K} % 90 AS STRING), CASE WHEN {K} % 5 = 0 THEN ' superior' WHEN {K} % 5 = 1 THEN ' mijlociu' WHEN {K} % 5 = 2 THEN ' inferior' ELSE '' END)",
    "judet": "n_name",
    "locality": f"CASE WHEN {K} % 11 = 0 THEN NULL ELSE concat('Loc ', CAST({K} % 13 AS STRING)) END",
    "kind": f"CASE WHEN {K} % 3 = 0 THEN 'river' WHEN {K} % 3 = 1 THEN 'lake' ELSE 'pond' END",
    "contracted": f"{K} % 2 = 0",
    "association_id": f"concat('a-', CAST({K} % 97 AS STRING))",
    "lon": f"20.26 + CAST({K} * 7919 % 9430 AS DOUBLE) / 1000",
    "lat": f"43.62 + CAST({K} * 104729 % 4650 AS DOUBLE) / 1000",
    "length_km": f"CASE WHEN {K} % 5 = 0 THEN NULL ELSE CAST({K} * 37 % 900 AS DOUBLE) / 10 END",
    "area_ha": f"CASE WHEN {K} % 4 = 0 OR {K} % 3 = 0 THEN NULL ELSE CAST({K} * 53 % 4000 AS DOUBLE) / 10 END",
    "min_lon": f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE 20.26 + CAST({K} * 7919 % 9430 AS DOUBLE) / 1000 - CAST({K} % 4 AS DOUBLE) / 100 END",
    "max_lon": f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE 20.26 + CAST({K} * 7919 % 9430 AS DOUBLE) / 1000 + CAST({K} % 5 AS DOUBLE) / 100 END",
    "min_lat": f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE 43.62 + CAST({K} * 104729 % 4650 AS DOUBLE) / 1000 - CAST({K} % 3 AS DOUBLE) / 100 END",
    "max_lat": f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE 43.62 + CAST({K} * 104729 % 4650 AS DOUBLE) / 1000 + CAST({K} % 7 AS DOUBLE) / 100 END",
    "river_group": f"concat('g-', CAST({K} % 140 AS STRING))",
    "course_frac": f"CASE WHEN {K} % 6 = 0 THEN NULL ELSE CAST({K} * 31 % 1000 AS DOUBLE) / 1000 END",
    "sector_start": f"CASE WHEN {K} % 4 = 1 THEN CAST({K} * 97 % 800 AS DOUBLE) / 1000 ELSE NULL END",
    "sector_end": f"CASE WHEN {K} % 4 = 1 THEN CAST({K} * 97 % 800 AS DOUBLE) / 1000 + CAST({K} % 9 + 1 AS DOUBLE) / 100 ELSE NULL END",
    "balance": "c_acctbal",
}
CONTRACT = {
    "course": "l_orderkey",
    "item": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))",
    "i_start": "CAST((l_linenumber * 97 + l_partkey) % 800 AS DOUBLE) / 1000",
    "i_end": "least(CAST(1 AS DOUBLE), CAST((l_linenumber * 97 + l_partkey) % 800 AS DOUBLE) / 1000 + (l_quantity + 1) / 250)",
}


def _select(exprs: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {source}"


WATERS_SQL = _select(WATER, "customer JOIN nation ON c_nationkey = n_nationkey")
CONTRACTS_SQL = _select(CONTRACT, "lineitem")
WITH = f"WITH waters AS ({WATERS_SQL}), contracts AS ({CONTRACTS_SQL}) "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in WATER.items()])


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in CONTRACT.items()])
