"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, host_rules, lexical, license, media, packing, simhash, substring, suffix_array, toxicity, url_filter, vector_codes, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, _read(spark, sf_dir, "pages")).drop("url")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hexed(simhash.classes(_read(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_repeated_windows(_read(spark, sf_dir, "documents")))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digests(suffix_array.remove_repeated_strings(_read(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(spark, _read(spark, sf_dir, "documents"))


def pages_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's html as ordered text and media structs, a row per struct."""
    found = media.interleaved(_read(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", F.inline("sequence"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(_read(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_warc, op2_simhash, op3_substring_dedup, op4_suffix_array_dedup, op5_url_filter, op6_media_columns, pages_interleaved, op7_license_scan, op8_toxicity, op9_best_fit_packing, op10_decontamination, op11_vector_codes, op12_ranked_search, op13_host_rules)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {
        "op1_warc": warc.SQL,
        "op7_license_scan": license.SQL,
        "op10_decontamination": decontam.SQL,
        "op11_vector_codes": vector_codes.SQL,
        "op12_ranked_search": lexical.SQL,
        "op13_host_rules": host_rules.SQL,
    }
