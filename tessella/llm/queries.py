"""Registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, decontam, mixing, pii, quality, simhash, spotsigs, suffix, tokencount, urlfilter
from .common import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge_urls(read(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", "via")


def op2_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy_passages(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.removed_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "source", "lang", "host_share", "path_share", "evidence", "posterior", "keep")


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hex_result(simhash.simhash_components(read(spark, sf_dir, "documents")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.in_order(mixing.mix(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "start", F.round(F.get("positions", F.lit(0)), 9).alias("position"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.length_histogram(tokencount.encoded_lengths(read(spark, sf_dir, "documents")))


def op9_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(read(spark, sf_dir, "documents"))


def op10_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


ALL = (
    op1_url_filters,
    op2_collinear_chaining,
    op3_suffix_dedup,
    op4_quality_classifier,
    op5_simhash_neardup,
    op6_source_mixing,
    op7_benchmark_decontamination,
    op8_token_counts,
    op9_spotsigs_fingerprints,
    op10_pii_boosting,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": urlfilter.SQL, "op6_source_mixing": mixing.SQL}
