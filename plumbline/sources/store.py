"""An append-only review table whose latest version of each key is the current one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Versions are appended, never rewritten, so readers always see whole batches; ``current`` is the upsert's result."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("review_id",), read_only: bool = False):
        self.spark, self.path, self.key, self.read_only = spark, path, list(key), read_only
        if read_only and self._versions() is None:
            raise FileNotFoundError(path)

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def ingest(self, rows: DataFrame) -> None:
        """Adds or replaces rows by key; the last write wins, within a batch the largest row in value order."""
        if self.read_only:
            raise PermissionError("the store is read-only")
        old = self._versions()
        batch = ((old.agg(F.max("version")).first()[0] or 0) if old is not None else 0) + 1
        rows.withColumn("version", F.lit(batch).cast("long")).write.mode("append").parquet(self.path)

    def current(self) -> DataFrame:
        df = self._versions()
        if df is None:
            raise FileNotFoundError(self.path)
        rest = [c for c in df.columns if c not in (*self.key, "version")]
        latest = df.groupBy(*self.key).agg(F.max(F.struct("version", *rest)).alias("m"))
        return latest.select(*self.key, *[F.col(f"m.`{c}`").alias(c) for c in rest])
