"""A training-data pipeline over ``documents``: what a stage decides is what the next one gets.

quality rules (rejected documents go), SimHash near-dedup (one document of each group stays),
benchmark decontamination (documents that hold an item go), secret scans (secrets are replaced), best-fit
packing (the last: one row a piece). All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torrentine.llm.common import materialize, table
from torrentine.llm.decontam import decontaminated
from torrentine.llm.packing import pack
from torrentine.llm.quality import keep_good
from torrentine.llm.secrets import redacted
from torrentine.llm.simhash import keep_one
from torrentine.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep. Null and empty texts go; null identifiers and repeated rows are judged by their text; an empty table stays empty."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group by op2's contract. Of repeated rows one stays; rows with a null doc_id pass unjudged; an empty table stays empty."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item. Null texts stay; null and blank items match nothing; repeated rows share one verdict; an empty table stays empty."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; ``n_chars`` follows the text. Every row stays, with null texts and identifiers as they were."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece; null and empty texts are their end id, null identifiers and repeated rows documents of their own; an empty table gives none."""
    return pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can't express fingerprints, edit distance, zstandard or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each over all that its predecessor kept; columns of any other name are carried to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
