"""Queries of the review analytics over the reviews table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.num import rnd
from plumbline.operators import keywords as kw
from plumbline.operators import places, reviewers, temporal, texts
from plumbline.operators.base import review_view
from plumbline.plans import reference_sql
from plumbline.session import materialise, table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rv(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return review_view(table(spark, d, "reviews"), list(columns) or None, table(spark, d, "review_sources"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Counts per place and day as a table: what is built on it reads it several times."""
    return materialise(temporal.daily_counts(rv(spark, d, "place_id", "rating", "day")), "daily")


@query
def place_rollup(spark, d):
    return places.place_rollup(rv(spark, d))


@query
def place_meta_best(spark, d):
    return places.place_meta(rv(spark, d))


@query
def store_counts(spark, d):
    return places.store_counts(rv(spark, d, "reviewer_id", "place_id"))


@query
def filtered_reviews(spark, d):
    cond = places.review_filter("2023-01-01", "2023-12-31", [1, 5])
    return rv(spark, d, "place_id", "rating", "place_category", "reviewer_id", "day").where(cond).select("review_id", "place_id", "rating", "day")


@query
def filtered_places(spark, d):
    meta = places.place_meta(rv(spark, d)).withColumn("duplicate_rate", F.lit(None).cast("double"))
    return meta.where(places.place_filter(10, "an", (0.0, 0.5))).select("place_id", "place_name", "review_count")


@query
def capabilities(spark, d):
    return places.capabilities(rv(spark, d))


@query
def data_quality(spark, d):
    return places.data_quality(rv(spark, d))


@query
def repeated_ids(spark, d):
    return places.repeated_ids(table(spark, d, "reviews"))


@query
def rating_distribution(spark, d):
    return places.rating_distribution(rv(spark, d, "rating"))


@query
def rating_over_time(spark, d):
    return places.rating_over_time(rv(spark, d, "rating", "day"))


@query
def category_quartiles(spark, d):
    per = places.place_meta(rv(spark, d)).select("place_id", "place_category", "review_count")
    avg = rv(spark, d, "place_id", "rating").groupBy("place_id").agg(F.avg("rating").alias("avg_rating"))
    return places.category_quartiles(per.join(avg, "place_id"), "avg_rating")


@query
def place_ranking(spark, d):
    r = rv(spark, d, "place_id", "place_name", "rating", "reviewer_id")
    per = r.groupBy("place_id").agg(
        F.min("place_name").alias("place_name"), F.count(F.lit(1)).alias("reviews"), rnd(F.avg("rating"), 4).alias("avg_rating"),
        F.countDistinct("reviewer_id").alias("reviewers"),
    )
    return places.ranking(per, {"most_reviews": ("reviews", True), "best_rated": ("avg_rating", True), "worst_rated": ("avg_rating", False), "most_reviewers": ("reviewers", True)})


@query
def daily_counts_filled(spark, d):
    return temporal.fill_calendar(daily(spark, d)).select("place_id", "day", "n")


@query
def burst_events(spark, d):
    return temporal.burst_events(daily(spark, d))


def _bursts(spark, d):
    days = daily(spark, d)
    events = materialise(temporal.burst_events(days), "events")
    return days, events, temporal.rating_shifts(days, events)


@query
def rating_anomaly_jsd(spark, d):
    return _bursts(spark, d)[2]


@query
def event_days(spark, d):
    _, events, shifts = _bursts(spark, d)
    return temporal.event_days(events, shifts)


@query
def burst_strength(spark, d):
    _, events, shifts = _bursts(spark, d)
    return temporal.day_strengths(events, shifts)


@query
def temporal_gap_signal(spark, d):
    return temporal.gap_signal(daily(spark, d))


@query
def temporal_peer_signal(spark, d):
    return temporal.peer_counts(daily(spark, d))


@query
def top_reviewer_share(spark, d):
    return reviewers.top_reviewer_share(rv(spark, d, "place_id", "reviewer_id"))


@query
def reviewer_metrics(spark, d):
    return reviewers.reviewer_metrics(rv(spark, d))


@query
def category_experience(spark, d):
    return reviewers.category_experience(rv(spark, d))


@query
def local_familiarity(spark, d):
    return reviewers.local_familiarity(rv(spark, d))


@query
def reviewer_relevance(spark, d):
    return reviewers.reviewer_relevance(rv(spark, d))


@query
def specificity(spark, d):
    return texts.specificity_scores(rv(spark, d, "text"))


@query
def content_token_counts(spark, d):
    t = rv(spark, d, "text").select("review_id", texts.content_tokens(F.col("text")).alias("t"))
    return t.select("review_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.size(texts.ngrams(F.col("t"), 2)).alias("bigrams"))


@query
def phrase_reuse(spark, d):
    return texts.phrase_reuse(rv(spark, d, "place_id", "text"))


@query
def unique_detail(spark, d):
    return texts.unique_detail(rv(spark, d, "place_id", "text"))


@query
def sentence_profiles(spark, d):
    of_10000 = F.transform("profile", lambda x: F.floor(x * 10000 + 0.5).cast("long").cast("string"))
    return texts.sentence_profiles(rv(spark, d, "place_id", "text")).select("review_id", F.array_join(of_10000, ",").alias("profile"))


@query
def structure_similarity(spark, d):
    return texts.structure_similarity(rv(spark, d, "place_id", "text"))


@query
def style_uniformity(spark, d):
    return texts.style_uniformity(rv(spark, d, "place_id", "text"))


@query
def exact_duplicate_groups(spark, d):
    return texts.exact_groups(rv(spark, d, "place_id", "text"))


@query
def bigram_peers(spark, d):
    return texts.bigram_peers(rv(spark, d, "place_id", "text"))


def _docs(spark, d, *columns):
    return rv(spark, d, "text", *columns).withColumnRenamed("review_id", "doc")


@query
def tfidf_keywords(spark, d):
    return kw.keywords(_docs(spark, d, "country").where("country IS NOT NULL"), "country")


@query
def keywords_by_sentiment(spark, d):
    side = F.when(F.col("rating") >= 4, "positive").when(F.col("rating") <= 2, "negative")
    return kw.keywords(_docs(spark, d, "rating").withColumn("side", side).where("side IS NOT NULL"), "side", 10)


@query
def keywords_by_rating(spark, d):
    return kw.keywords(_docs(spark, d, "rating").where("rating IS NOT NULL"), "rating", 8)


@query
def emerging_keywords(spark, d):
    dated = materialise(_docs(spark, d, "country", "day"), "docs").where("country IS NOT NULL AND day IS NOT NULL")
    last = dated.groupBy("country").agg(F.max("day").alias("anchor"))
    return kw.emerging(dated.join(last, "country"), "country", F.col("anchor"))


ORACLES = reference_sql.ORACLES
