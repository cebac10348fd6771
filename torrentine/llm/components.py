"""Connected components of an edge table by alternating large-star and small-star rounds.

Nothing but two totals comes to the driver. Each round is checkpointed in the shared folder, so lineage
stays short and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentine.llm.common import shared_dir


def _stars(near: DataFrame, keep) -> DataFrame:
    """near: (u, v), all neighbours v of u. Links each kept neighbour, and u itself where that is smaller, to the least of u and its neighbours."""
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    return joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has a link to another; component is its least node.

    ``edges`` has two long columns u and v, in either direction, repeats allowed; loops and nulls are
    dropped. An empty table gives an empty result.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, F.col("v") > F.col("u")).distinct()
        # small star: u and its smaller neighbours hang on the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        e = small.distinct().checkpoint()
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
