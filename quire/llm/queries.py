"""One query for each training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .fingerprints import fingerprint_report
from .html_main import extract_main
from .langid import identify
from .line_dedup import LINE_DEDUP_SQL, line_dedup_report
from .media import media_report
from .mixing import mixing_report
from .near_dups import NEAR_DUPLICATES_SQL, near_duplicates
from .pieces import encoded
from .quality import quality_report
from .substrings import SUBSTRINGS_SQL, remove_repeats


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pieces, op2_mixing, op3_main_text, op4_line_dedup, op5_quality, op6_substrings, op7_fingerprints, op8_near_duplicates, op9_language, op10_media)}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": LINE_DEDUP_SQL, "op6_substrings": SUBSTRINGS_SQL, "op8_near_duplicates": NEAR_DUPLICATES_SQL}
