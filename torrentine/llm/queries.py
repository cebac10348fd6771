"""Queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from torrentine.llm.common import table
from torrentine.llm.oracles import SQL
from torrentine.llm.tokens import vocabulary


def op9_token_id_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.sstable import token_id_table

    return token_id_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.substring import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"), width=35)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7's base patterns, which SQL can express."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"))


def op4_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.html_cut import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.separators import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=50256)


def op11_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.concat import concat_and_cut

    return concat_and_cut(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from torrentine.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def queries() -> dict:
    found = (
        op1_decontamination,
        op2_simhash_near_dedup,
        op3_warc_chunks,
        op4_html_min_cut,
        op5_quality_rules,
        op6_best_fit_packing,
        op7_secret_scan,
        op8_token_counts,
        op9_token_id_sstable,
        op10_substring_dedup,
        op11_concat_packing,
        op12_conversation_repair,
        op13_importance_resampling,
        secret_counts,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
