"""Human verdicts as an append-only log with a batch that is open or finalised."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.labels import LABEL_COLUMNS


class BatchFinalised(RuntimeError):
    pass


class FingerprintMismatch(RuntimeError):
    pass


class Annotations:
    """Verdicts below ``path``: the latest of each review is current, older ones are its revisions.

    A finalised batch takes verdicts only with ``override`` and is bound to the fingerprint of its dataset.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _labels(self) -> DataFrame:
        return self._log("labels", ", ".join(f"{c} string" for c in LABEL_COLUMNS) + ", version long")

    def _batches(self) -> DataFrame:
        return self._log("batches", "version long, status string, finalised_at string, annotator_id string, fingerprint string")

    def save(self, labels: DataFrame, override: bool = False) -> None:
        """Adds verdicts; of repeated reviews in one call the largest row in column order counts."""
        if self.status() == "FINALIZED" and not override:
            raise BatchFinalised("the batch is finalised; pass override to revise it")
        version = (self._labels().agg(F.max("version")).first()[0] or 0) + 1
        rows = labels.select(*[F.col(c).cast("string").alias(c) if c in labels.columns else F.lit(None).cast("string").alias(c) for c in LABEL_COLUMNS]).where("review_id IS NOT NULL")
        one = rows.groupBy("review_id").agg(F.max(F.struct(*LABEL_COLUMNS)).alias("m")).select("m.*")
        one.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{self.path}/labels")

    def current(self) -> DataFrame:
        latest = self._labels().groupBy("review_id").agg(F.max_by(F.struct(*LABEL_COLUMNS), "version").alias("m"))
        return latest.select("m.*")

    def revisions(self) -> DataFrame:
        """Every verdict that a later one replaced."""
        labels = self._labels()
        last = labels.groupBy("review_id").agg(F.max("version").alias("last"))
        return labels.join(last, "review_id").where("version < last").drop("last")

    def unlabelled(self, ids: DataFrame) -> DataFrame:
        return ids.select("review_id").distinct().join(self._labels(), "review_id", "left_anti")

    def progress(self) -> DataFrame:
        return self.current().groupBy(F.coalesce("sample_type", F.lit("unattributed")).alias("sample_type")).agg(F.count(F.lit(1)).alias("labelled"))

    def batch(self):
        rows = self._batches().orderBy(F.desc("version")).limit(1).collect()
        return rows[0] if rows else None

    def status(self) -> str:
        return self.batch()["status"] if self.batch() else "OPEN"

    def finalise(self, annotator_id: str, fingerprint: str, at: str, override: bool = False) -> None:
        now = self.batch()
        if now and not override:
            raise BatchFinalised("the batch is finalised already")
        if now and now["fingerprint"] != fingerprint:
            raise FingerprintMismatch("the batch is bound to another dataset")
        row = ((now["version"] if now else 0) + 1, "FINALIZED", at, annotator_id, fingerprint)
        self.spark.createDataFrame([row], self._batches().schema).write.mode("append").parquet(f"{self.path}/batches")

    def verify(self, fingerprint: str) -> bool:
        now = self.batch()
        if not now or now["fingerprint"] != fingerprint:
            raise FingerprintMismatch("not finalised, or bound to another dataset")
        return True
