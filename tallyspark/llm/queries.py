"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchors, byte_bpe, language_id, max_plus, mixing, multi_index, paragraphs, periodic_runs, product_quantisation, style_tree, url_rules, warc_zip, weighted_minhash
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.neighbours(table(spark, sf_dir, "embeddings"), f"vec_id % {multi_index.QUERY_STEP} = 0")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extracted(table(spark, sf_dir, "pages"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_quantisation.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_plus.encoded(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(table(spark, sf_dir, "documents"))))


def op12_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.with_label_errors(*anchors.compressed(table(spark, sf_dir, "embeddings")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.searched(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc_zip": warc_zip.ORACLE_SQL,
        "op9_url_rules": url_rules.ORACLE_SQL,
        "op12_anchor_codes": anchors.oracle_sql(),
        "op13_periodic_runs": periodic_runs.ORACLE_SQL,
    }
