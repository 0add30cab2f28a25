"""Daily counts of a stream of reviews with late arrivals, and their batch upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(stream: DataFrame, time: str = "ts", key: str = "place_id", late: str = "30 days") -> DataFrame:
    """(key, day, n, rating_sum) in day windows; rows later than ``late`` behind the newest are left out by the watermark."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, "1 day").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum"))
        .select(key, F.to_date("w.start").alias("day"), "n", "rating_sum")
    )


def upsert(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's updated days below its batch number; a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, key: str = "place_id") -> DataFrame:
    df = spark.read.parquet(path)
    return df.groupBy(key, "day").agg(F.max_by(F.struct("n", "rating_sum"), "batch").alias("m")).select(key, "day", "m.n", "m.rating_sum")
