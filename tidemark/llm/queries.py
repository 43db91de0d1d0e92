"""The queries of this package; each takes the session and the folder of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import abuse, glyphs, history, leakage, linkage, mixing, setjoin, survivorship
from tidemark.plans.shared import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.found(load(spark, d, "github_records"))


def p1_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.golden_records(load(spark, d, "github_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.found(load(spark, d, "source_records"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.unify_fields(load(spark, d, "source_records"), "record_id", ["title", "summary"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p6_edited(spark: SparkSession, d: str) -> DataFrame:
    return leakage.edited(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.found(load(spark, d, "source_records"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.groups(load(spark, d, "source_records"), "record_id", ["title", "summary"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.found(load(spark, d, "edition_items"), load(spark, d, "incoming_items"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return history.matches(load(spark, d, "edition_items"), load(spark, d, "incoming_items"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.found(load(spark, d, "arxiv_records"), load(spark, d, "github_records"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(load(spark, d, "arxiv_records"), load(spark, d, "github_records"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(load(spark, d, "documents"), load(spark, d, "review_labels"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(load(spark, d, "documents"), load(spark, d, "review_labels"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(load(spark, d, "documents"), load(spark, d, "review_labels"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1].isdigit() and callable(f)}
