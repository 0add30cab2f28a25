"""Label, event, selection and score files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.validation import ENUMS, clean_labels
from plumbline.sources.files import read_csv

# The columns of the label and event files, in order.
LABEL_COLUMNS = (
    "review_id templated_label template_group_id specificity_label duplicate_group_id duplicate_label reviewer_notes annotation_schema_version annotator_id labeled_at sample_type sampling_stratum"
).split()
EVENT_COLUMNS = "place_id event_id start_date end_date polarity coordinated_label notes annotation_schema_version annotator_id labeled_at".split()


def _with(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with their warnings; missing columns are null, unknown verdicts null with a warning."""
    raw = _with(read_csv(spark, path), LABEL_COLUMNS)
    kept = [c for c in LABEL_COLUMNS if c not in {*ENUMS, "review_id", "template_group_id", "duplicate_group_id", "annotator_id"}]
    return clean_labels(raw, kept)


def _write(df: DataFrame, path: str) -> None:
    df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns]).write.csv(path, header=True, escape='"', quoteAll=True, mode="overwrite")


def write_labels(labels: DataFrame, path: str) -> None:
    """CSV in the canonical order, null as empty; columns that ``labels`` lacks are empty."""
    _write(_with(labels, LABEL_COLUMNS), path)


def label_template(ids: DataFrame) -> DataFrame:
    """Empty label rows for the given (review_id[, sample_type, sampling_stratum])."""
    return _with(ids, LABEL_COLUMNS).withColumn("annotation_schema_version", F.lit("1.0"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _with(read_csv(spark, path), EVENT_COLUMNS)


def write_events(events: DataFrame, path: str) -> None:
    _write(_with(events, EVENT_COLUMNS), path)


def read_selection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, entries) of a selection document; a document that holds scores is an error."""
    doc = spark.read.json(path, multiLine=True)
    entries = doc.select(F.explode("entries").alias("e")).select("e.*")
    if [c for c in entries.columns if "score" in c]:
        raise ValueError("a selection must not hold scores")
    return doc.drop("entries"), entries


def write_selection(entries: DataFrame, path: str, **header) -> None:
    """One JSON document; a selection is a bounded sample, a few thousand rows at most."""
    rows = [r.asDict() for r in entries.select("review_id", "sample_type", "sampling_stratum", "place_id").orderBy("review_id").collect()]
    text = json.dumps({**header, "entries": rows}, ensure_ascii=False)
    entries.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_scores(scores: DataFrame, path: str, fingerprint: str) -> None:
    """The score table with the fingerprint of the dataset it was made from."""
    scores.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str, reviews: DataFrame, fingerprint: str) -> DataFrame:
    """The score table for these reviews; another fingerprint, or a review without a score, is an error."""
    scores = spark.read.parquet(path)
    if scores.where(F.col("fingerprint") != fingerprint).limit(1).count():
        raise ValueError("the scores are of another dataset")
    missing = reviews.select("review_id").join(scores, "review_id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no score for {missing[0][0]}")
    return scores.drop("fingerprint")
