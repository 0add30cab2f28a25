"""Queries of the general data-pipeline problems (1, 3, 4 and 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import features, records, reviews, rolling, timestamps
from plumbline.plans import general_sql
from plumbline.session import table

REVIEW_FIELDS = (
    "review_id place_id place_name place_category reviewer_id reviewer_name rating text published_at city region country"
    " latitude longitude source source_url"
).split()

#: Categories that one feature table of ``p1_found`` holds; more get a table for each so many.
TYPES = 500


def _dated(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current reviews with their UTC day."""
    raw = table(spark, d, "reviews").select("review_id", *columns, "published_at", "source", "ingested_at")
    dated = timestamps.with_instants(raw, table(spark, d, "review_sources"))
    return reviews.current_reviews(dated, [*columns, "utc_day"])


def _p1_long(spark: SparkSession, d: str) -> DataFrame:
    return features.entity_type_table(_dated(spark, d, "reviewer_id", "place_category", "rating"), "reviewer_id", "place_category")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Read from the feature table's columns of each category; an active period of 1 day is one date or two in a row."""
    long = _p1_long(spark, d)
    kinds = features.type_list(table(spark, d, "reviews"), "place_category", most=None)
    brief = lambda of: (of("dated_count") >= 4) & (of("active_period_days") <= 1)
    found = []
    for i in range(0, max(1, len(kinds)), TYPES):
        some = kinds[i : i + TYPES]
        wide = features.entity_features(long, "reviewer_id", "place_category", some, as_of="2025-01-01")
        found.append(features.types_where(wide, "reviewer_id", "place_category", some, brief))
    return reduce(DataFrame.union, found)


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    long = _p1_long(spark, d)
    kinds = features.type_list(table(spark, d, "reviews"), "place_category")
    return features.entity_features(long, "reviewer_id", "place_category", kinds, as_of="2025-01-01")


def p1_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The feature table's measures of each type, a row each."""
    return features.by_type(p1_features(spark, d), "reviewer_id", features.type_list(table(spark, d, "reviews"), "place_category"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    return p1_features(spark, d).select("reviewer_id", "review_count", *features.PER_TYPE)


def _p3(spark: SparkSession, d: str) -> DataFrame:
    return records.parse_records(table(spark, d, "raw_review_lines"), REVIEW_FIELDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).where(F.col("reason").isNull()).drop("reason", "error_offset", "error_field")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_days(_dated(spark, d, "place_id", "rating"), "place_id", "utc_day", "rating", (7, 30))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    dense = (F.col("events_7") >= 10) & (F.col("events_7") * 5 >= F.col("events_30") * 4)
    return (
        _p4(spark, d)
        .where((F.col("day_number") >= 30) & dense)
        .select("place_id", F.date_format("activity_day", "yyyy-MM-dd").alias("activity_day"))
    )


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_timestamps(table(spark, d, "reviews"), table(spark, d, "review_sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).where("rewritten AND published_utc IS NOT NULL").select("review_id", "published_utc")


def p6_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p1_features, p1_by_type, p1_totals, p3_found, p3_rows, p4_found, p4_rolling, p6_found, p6_timestamps)}
ORACLES = dict(general_sql.ORACLES)
