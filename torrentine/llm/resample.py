"""Importance resampling towards a target distribution of hashed word n-grams.

A document is an array of buckets, made by higher-order functions and written once. Of the corpus only
the bucket totals are shuffled, as many rows as there are buckets; the gain of each bucket then is an entry of one
array literal, and a document's weight is an aggregate over its own array. No feature becomes a row on the
scoring path. The draw is a sort by range with the counts of its partitions, so no task ranks all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torrentine.llm.common import materialize

BUCKETS = 10_000
#: ASCII characters that are no letter or digit part words; A-Z is lower-cased before.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART), "")


def _shifted(a: Column, by: int) -> Column:
    """The array from its element ``by`` on; empty if it is shorter."""
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _joined(a: Column, b: Column) -> Column:
    """Each element of ``b`` after its counterpart in ``a``, as far as ``b`` goes."""
    return F.zip_with(F.slice(a, 1, F.size(b)), b, lambda x, y: F.concat(x, F.lit(" "), y))


def bucket_arrays(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """All columns with n_words and b, the bucket of each run of one to three words, repeats included. A null text has none."""
    words = df.withColumn("_w", plain_words(F.col(text_col).cast("string")))
    pairs = words.withColumn("_p", _joined(F.col("_w"), _shifted(F.col("_w"), 1)))
    bucket = lambda a: F.transform(a, lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(buckets)).cast("short" if buckets <= 1 << 15 else "int"))
    triples = _joined(F.col("_p"), _shifted(F.col("_w"), 2))
    return pairs.withColumn("b", F.concat(bucket(F.col("_w")), bucket(F.col("_p")), bucket(triples))).withColumn("n_words", F.size("_w")).drop("_w", "_p")


def bucket_counts(arrays: DataFrame) -> dict[int, int]:
    """Features in each bucket; tasks send one row a bucket at most."""
    return {r.k: r.n for r in arrays.select(F.explode("b").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of how much more of the target falls into each bucket, both counts smoothed by one."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(k, 0) + 1.0) * s_all / ((source.get(k, 0) + 1.0) * t_all))) for k in range(buckets)]


def weighed(arrays: DataFrame, gain: list[int]) -> DataFrame:
    """The rows with weight, the sum of the gains of their buckets (none: 0)."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded into one array literal
    total = F.aggregate("b", F.lit(0).cast("long"), lambda acc, k: acc + F.element_at(literal, k.cast("int") + 1))
    return arrays.withColumn("weight", total)


def noise(key: Column, seed: int = 42) -> Column:
    """floor of a thousandfold Gumbel draw that depends on the seed and the key alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with n, 1, 2, 3 ... in the given total order.

    They are sorted by range and written; their number in the partition and the counts of the partitions before
    give the rest. Rows that are equal in the order are told apart by their number, so they spread over partitions too.
    """
    spark = rows.sparkSession
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "unranked")  # numbers that stay
    sorted_rows = numbered.orderBy(*order, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id())
    kept = materialize(sorted_rows, "ranked")
    part = F.shiftright("_at", 33)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(part.alias("part")).count()  # one row a partition
    base = counts.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base")).collect()
    table = spark.createDataFrame([tuple(r) for r in base], "part long, base long")
    return kept.withColumn("part", part).join(F.broadcast(table), "part").withColumn("n", F.col("base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "base", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row a document; ``rank`` is null where it is not drawn.

    Of the documents with ``least_words`` words the ``percent`` with the highest scores are drawn, ties to the smaller
    doc_id. Null and empty texts have no features, weight 0 and are never drawn. A null doc_id counts as an empty
    string in the noise and comes last among ties. Repeated rows are documents of their own. An empty target leaves gains of the
    corpus alone; an empty corpus gives no rows. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    arrays = materialize(bucket_arrays(own, buckets=buckets).select("doc_id", "n_words", "b"), "buckets")
    wanted = bucket_arrays(target.select(F.col("text").cast("string").alias("text")), buckets=buckets)
    gain = gains(bucket_counts(arrays), bucket_counts(wanted), buckets)
    scored = weighed(arrays, gain).select(
        "doc_id",
        F.size("b").cast("long").alias("n_features"),
        "weight",
        (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long").alias("score"),
        (F.col("n_words") >= least_words).alias("fit"),
    )
    draws = percent * arrays.where(F.col("n_words") >= least_words).count() // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    drawn = F.col("fit") & (F.col("n") <= draws)
    return ranked(scored, order).select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("n")).cast("long").alias("rank"))


def drawn(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The documents whose doc_id ``result`` has drawn, with all their columns; of repeated rows all come with the first that is drawn."""
    ids = result.where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")
