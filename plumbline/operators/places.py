"""Rollups of places, categories, ratings and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.num import rnd

PLACE_KEYS = ["place_id", "place_name", "place_category", "city", "region", "country"]


def place_rollup(rv: DataFrame) -> DataFrame:
    """One row per place and spelling of its metadata; null keys group together."""
    return rv.groupBy(*PLACE_KEYS).agg(
        F.min("latitude").alias("latitude"),
        F.min("longitude").alias("longitude"),
        F.count(F.lit(1)).alias("review_count"),
        F.countDistinct("reviewer_id").alias("reviewer_count"),
        rnd(F.avg("rating"), 4).alias("avg_rating"),
        F.min("published_at").alias("first_published"),
        F.max("published_at").alias("last_published"),
    )


def place_meta(rv: DataFrame) -> DataFrame:
    """The metadata of each place that most of its reviews carry; ties: the smaller name, then category."""
    best = Window.partitionBy("place_id").orderBy(
        F.desc("review_count"), F.asc_nulls_last("place_name"), F.asc_nulls_last("place_category"), F.asc_nulls_last("city"),
        F.asc_nulls_last("region"), F.asc_nulls_last("country"),
    )
    rolled = rv.groupBy(*PLACE_KEYS).agg(F.count(F.lit(1)).alias("review_count"))
    return rolled.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def store_counts(rv: DataFrame) -> DataFrame:
    return rv.agg(
        F.count(F.lit(1)).alias("reviews"), F.countDistinct("reviewer_id").alias("reviewers"), F.countDistinct("place_id").alias("places")
    )


def review_filter(day_from: str | None = None, day_to: str | None = None, ratings: list[int] | None = None, categories: list[str] | None = None, reviewers: list[str] | None = None) -> Column:
    """Predicate of the review filter: null days, ratings and categories pass; the reviewer list is strict."""
    ok = F.lit(True)
    if day_from:
        ok &= F.col("day").isNull() | (F.col("day") >= F.lit(day_from).cast("date"))
    if day_to:
        ok &= F.col("day").isNull() | (F.col("day") <= F.lit(day_to).cast("date"))
    if ratings:
        ok &= F.col("rating").isNull() | F.col("rating").isin(ratings)
    if categories:
        ok &= F.col("place_category").isNull() | F.col("place_category").isin(categories)
    if reviewers:
        ok &= F.col("reviewer_id").isin(reviewers)
    return ok


def place_filter(min_reviews: int = 0, query: str = "", rate: tuple[float, float] | None = None) -> Column:
    """Predicate of the place filter: a null count is 0, a null duplicate rate passes, the text is literal."""
    ok = F.coalesce(F.col("review_count"), F.lit(0)) >= min_reviews
    if query:
        q = F.lit(query.lower())
        ok &= F.contains(F.lower(F.coalesce("place_name", F.lit(""))), q) | F.contains(F.lower("place_id"), q)
    if rate:
        ok &= F.col("duplicate_rate").isNull() | F.col("duplicate_rate").between(*rate)
    return ok


def capabilities(rv: DataFrame) -> DataFrame:
    """What the dataset supports, in counts."""
    text = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    per = rv.groupBy("reviewer_id").agg(F.countDistinct("place_id").alias("p")).agg(F.count_if(F.col("p") > 1).alias("multi_place_reviewers"))
    return rv.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.countDistinct("place_id").alias("places"),
        F.countDistinct("reviewer_id").alias("reviewers"),
        F.count("day").alias("dated_reviews"),
        F.count("rating").alias("rated_reviews"),
        F.count_if(text).alias("texts"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("located_reviews"),
        F.countDistinct("place_category").alias("categories"),
    ).crossJoin(per)  # one row by one row


def data_quality(rv: DataFrame) -> DataFrame:
    """Counts of missing and invalid values; a complete row may lack the date but must not have a wrong one."""
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    wrong = ~blank("published_at") & F.col("day").isNull()
    zero = (F.col("latitude") == 0) & (F.col("longitude") == 0)
    return rv.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(blank("text")).alias("missing_text"),
        F.count_if(F.col("rating").isNull()).alias("missing_rating"),
        F.count_if(blank("published_at")).alias("missing_date"),
        F.count_if(wrong).alias("invalid_date"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("missing_coordinates"),
        F.count_if(zero).alias("zero_coordinates"),
        F.count_if(blank("place_category")).alias("missing_category"),
        F.count_if(~blank("text") & F.col("rating").isNotNull() & ~wrong).alias("complete"),
    )


def repeated_ids(reviews: DataFrame) -> DataFrame:
    return reviews.where("review_id IS NOT NULL").groupBy("review_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def rating_distribution(rv: DataFrame) -> DataFrame:
    """Reviews per star, 1 to 5, zeros included."""
    stars = rv.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    counts = rv.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return stars.join(counts, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def rating_over_time(rv: DataFrame) -> DataFrame:
    dated = rv.where("day IS NOT NULL AND rating IS NOT NULL")
    return dated.groupBy("day").agg(rnd(F.avg("rating"), 4).alias("avg_rating"), F.count(F.lit(1)).alias("n"))


def category_quartiles(places: DataFrame, metric: str) -> DataFrame:
    """Per category: places, reviews and the quartiles of a place metric (linear interpolation)."""
    q = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        places.groupBy(F.coalesce("place_category", F.lit("(no category)")).alias("place_category"))
        .agg(F.count(F.lit(1)).alias("places"), F.sum("review_count").alias("reviews"), q.alias("q"))
        .select("place_category", "places", "reviews", *[rnd(F.col("q")[i], 4).alias(n) for i, n in enumerate(["q1", "median", "q3"])])
    )


def ranking(places: DataFrame, sections: dict[str, tuple[str, bool]], top: int = 5) -> DataFrame:
    """The first ``top`` places of each section: {section: (metric, descending)}; null metrics are left out,
    ties go by name and id. One pass: the sections are unpivoted and each keeps its best rows."""
    rows = F.array(*[
        F.struct(F.lit(s).alias("section"), F.col(m).cast("double").alias("value"), (F.col(m) * (-1.0 if d else 1.0)).alias("o")) for s, (m, d) in sections.items()
    ])
    long = places.select("place_id", "place_name", F.explode(rows).alias("x")).select("place_id", "place_name", "x.*").where("value IS NOT NULL")
    w = Window.partitionBy("section").orderBy("o", F.asc_nulls_last("place_name"), "place_id")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("o")
