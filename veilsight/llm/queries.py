"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chunk_fingerprint,
    license_scan,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    substring_dedup,
    suffix_dedup,
    url_filter,
)
from ._common import documents
from .sql import ORACLE_SQL  # noqa: F401  the other operators carry hashes, models or keys that SQL can't state


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(documents(spark, sf_dir))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*base, F.round("posterior", 9).alias("posterior"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(documents(spark, sf_dir, "pages"))


def op10_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprint.fingerprint_with_next(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_substring_dedup,
        op3_mixing,
        op4_license_scan,
        op5_simhash,
        op6_quality_rules,
        op7_suffix_dedup,
        op8_packing,
        op9_url_filter,
        op10_chunk_fingerprint,
    )
}
