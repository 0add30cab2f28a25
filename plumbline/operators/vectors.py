"""The vector cache and aggregates of vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.num import rnd
from plumbline.functions.timeparse import strip


def text_hash(text: Column) -> Column:
    """The cache key of a text: sha256 of it trimmed and in lower case."""
    return F.sha2(F.lower(strip(F.coalesce(text, F.lit("")))), 256)


def cache_misses(rv: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Reviews with text that have no cached vector for their current text and ``model``."""
    keys = cache.where(F.col("model_name") == model).select("review_id", "text_hash").distinct()
    wanted = rv.where("text IS NOT NULL").select("review_id", text_hash(F.col("text")).alias("text_hash"))
    return wanted.join(keys, ["review_id", "text_hash"], "left_anti")


def cache_summary(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("review_id").alias("reviews"), F.count_if(F.col("embedding").isNull()).alias("null_vectors"),
        F.count_if(F.size("embedding") == 0).alias("empty_vectors"), F.max(F.size("embedding")).alias("longest"),
    )


def mean_cosine(vectors: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """Mean pairwise cosine per group from the sum of unit vectors: (|sum|^2 - n) / (n (n - 1)), so no pair is formed.
    1 for a single vector. Zero vectors and vectors of another length are left out."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    live = vectors.where(F.size(vector) == dim).withColumn("__n", norm).where("__n > 0")
    unit = live.select(group, array_to_vector(F.zip_with(vector, F.array_repeat("__n", dim), lambda x, n: x / n)).alias("u"))
    sums = unit.groupBy(group).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("u")).alias("s")).withColumn("s", vector_to_array("s"))
    sq = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    return sums.select(group, "n", rnd(F.when(F.col("n") < 2, 1.0).otherwise((sq - F.col("n")) / (F.col("n") * (F.col("n") - 1))), 6).alias("mean_cosine"))


def centre_cosines(vectors: DataFrame, group: str, key: str, vector: str, dim: int) -> DataFrame:
    """(group, key, cosine) of every vector with the mean of the unit vectors of its group, rounded to 3 digits."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    live = vectors.where(F.size(vector) == dim).withColumn("__n", norm).where("__n > 0")
    unit = live.select(group, key, F.zip_with(vector, F.array_repeat("__n", dim), lambda x, n: x / n).alias("u"))
    centre = unit.groupBy(group).agg(vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("c"))
    dot = F.aggregate(F.zip_with("u", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return unit.join(centre, group).select(group, key, rnd(dot / length, 3).alias("cosine"))
