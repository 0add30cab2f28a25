"""One comparison row per place, the rollup of its category, rankings and the context of families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.num import rnd
from plumbline.operators import places

#: section: (metric, descending)
SECTIONS = {
    "duplicate_rate": ("duplicate_rate", True), "largest_group": ("largest_family", True), "rating_delta": ("abs_rating_delta", True),
    "high_specificity": ("median_specificity", True), "low_specificity": ("median_specificity", False), "topic_clusters": ("topic_clusters", True),
    "templated": ("templated_max", True), "cohort": ("review_count", True), "one_star": ("one_star_share", True), "five_star": ("five_star_share", True),
    "coordinated": ("coordinated_score", True),
}
#: Sections that need one place above 0 to be shown at all.
POSITIVE = ("largest_group", "topic_clusters")


def _median(x: str) -> Column:
    return rnd(F.percentile(x, F.lit(0.5)), 4)


def place_summary(rv: DataFrame, meta: DataFrame, weighted: DataFrame, families: DataFrame, templated: DataFrame, coordinated: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per place with some twenty measures; a measure without evidence is null, never 0.

    ``rv`` needs ``spec``; ``families`` (review_id, family, family_size) count with their members in the place:
    those with two or more are families, those with three or more repeated text. A null place is left out.
    """
    own = rv.where("place_id IS NOT NULL")
    rated = F.count("rating")
    base = own.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("review_count"), F.countDistinct("reviewer_id").alias("reviewer_count"), F.count("published_at").alias("dated_review_count"),
        rnd(100 * F.count_if(F.col("rating") == 1) / F.nullif(rated, F.lit(0)), 4).alias("one_star_share"),
        rnd(100 * F.count_if(F.col("rating") == 5) / F.nullif(rated, F.lit(0)), 4).alias("five_star_share"),
        _median("spec").alias("median_specificity"), rnd(F.avg("spec"), 4).alias("mean_specificity"), F.max("day").alias("__day"),
    )
    named = meta.select("place_id", F.coalesce("place_name", "place_id").alias("place_name"), "place_category")
    sizes = own.select("review_id", "place_id").join(families.select("review_id", "family"), "review_id").groupBy("place_id", "family").agg(F.count(F.lit(1)).alias("k"))
    repeated = sizes.groupBy("place_id").agg(
        F.count_if(F.col("k") >= 2).alias("family_count"), F.max(F.when(F.col("k") >= 2, F.col("k"))).alias("largest_family"), F.sum(F.when(F.col("k") >= 3, F.col("k")).otherwise(0)).alias("repeated")
    )
    tpl = templated.groupBy("place_id").agg(F.count_if(F.col("templated") >= 65).alias("templated_high"), F.max("templated").alias("templated_max"), _median("templated").alias("templated_median"))
    topics = clusters.groupBy("place_id").agg(F.countDistinct("cluster_id").alias("topic_clusters"))
    out = base.join(named, "place_id", "left")
    for part in (weighted.select("place_id", "raw", "weighted"), repeated, tpl, topics, coordinated.select("place_id", "coordinated", F.col("band").alias("coordinated_band"))):
        out = out.join(part, "place_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    dated = F.max("__day").isNotNull()
    any_day = base.agg(dated.alias("__dated"))
    delta = rnd(F.col("raw") - F.col("weighted"), 4)
    return out.crossJoin(F.broadcast(any_day)).select(  # one row
        "place_id", "place_name", "place_category", "review_count", "reviewer_count", "dated_review_count", F.col("raw").alias("raw_rating"), F.col("weighted").alias("weighted_rating"),
        delta.alias("rating_delta"), F.abs(delta).alias("abs_rating_delta"), "one_star_share", "five_star_share", zero("family_count"), zero("largest_family"),
        rnd(100 * F.coalesce("repeated", F.lit(0)) / F.col("review_count"), 4).alias("duplicate_rate"), "median_specificity", "mean_specificity", zero("topic_clusters"), zero("templated_high"),
        "templated_max", "templated_median", F.when(F.col("__dated"), F.col("coordinated")).alias("coordinated_score"), F.when(F.col("__dated"), F.col("coordinated_band")).alias("coordinated_band"),
    )


def category_rollup(summary: DataFrame) -> DataFrame:
    """Per category: places, reviews, medians and quartiles of the place measures (linear interpolation, nulls left out)."""
    q = lambda c, p: rnd(F.percentile(c, F.lit(p)), 4)
    return summary.groupBy(F.coalesce("place_category", F.lit("(no category)")).alias("place_category")).agg(
        F.count(F.lit(1)).alias("places"), F.sum("review_count").alias("reviews"), q("review_count", 0.5).alias("median_reviews"),
        *[q(c, p).alias(f"{n}_{c}") for c in ("raw_rating", "duplicate_rate", "median_specificity") for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
        F.sum("topic_clusters").alias("topic_clusters_total"), F.count_if(F.col("topic_clusters") > 0).alias("places_with_clusters"),
        q("topic_clusters", 0.5).alias("median_clusters"), q("templated_max", 0.5).alias("median_templated_max"),
    )


def ranking_sections(summary: DataFrame, top: int = 5) -> DataFrame:
    """(section, rank, place_id, place_name, value): the first ``top`` places of each of the eleven sections.

    A section without a value, or of ``POSITIVE`` without a value above 0, has no rows.
    """
    ranked = places.ranking(summary, SECTIONS, top)
    shown = ranked.groupBy("section").agg(F.max("value").alias("most")).where(~F.col("section").isin(*POSITIVE) | (F.col("most") > 0)).select("section")
    return ranked.join(F.broadcast(shown), "section", "left_semi")  # at most one row a section


def place_listing(summary: DataFrame, categories: list[str] | None = None, min_reviews: int = 0, query: str = "", rate: tuple[float, float] | None = None) -> DataFrame:
    """The places that pass the filter, most reviews first; ties by name, nulls last."""
    kept = summary.where(places.place_filter(min_reviews, query, rate))
    if categories:
        kept = kept.where(F.col("place_category").isin(categories))
    return kept.orderBy(F.desc_nulls_last("review_count"), F.asc_nulls_last("place_name"), "place_id")


def family_context(rv: DataFrame, families: DataFrame) -> DataFrame:
    """Per family of at least two known reviews: rating context, distinct days and how concentrated they are.

    ``concentration``: 1 - (days - 1) / (members - 1), 1 for one day or none.
    """
    x = rv.select("review_id", "rating", "day").join(families.select("review_id", "family", "avg_similarity"), "review_id")
    modal = F.greatest(*[F.count_if(F.col("rating") == s) for s in range(1, 6)])
    n, days = F.count(F.lit(1)), F.countDistinct("day")
    out = x.groupBy("family").agg(
        n.alias("members"), F.min("rating").alias("low"), F.max("rating").alias("high"), (F.max("rating") - F.min("rating")).alias("spread"),
        rnd(modal / F.nullif(F.count("rating"), F.lit(0)), 4).alias("identical_share"), rnd(F.avg("rating"), 2).alias("avg_rating"), days.alias("days"),
        F.first("avg_similarity").alias("avg_similarity"),
    )
    spread = F.when((F.col("members") > 1) & (F.col("days") > 1), 1 - (F.col("days") - 1) / (F.col("members") - 1)).otherwise(F.lit(1.0))
    return out.where("members >= 2").withColumn("concentration", rnd(F.greatest(F.lit(0.0), spread), 3))


def family_filter(structure: DataFrame, context: DataFrame, min_size: int = 2, kinds: list[str] | None = None, min_similarity: float = 0.0, min_concentration: float = 0.0) -> DataFrame:
    """Families with at least ``min_size`` members, a link of any of ``kinds`` and at least the given similarity and concentration."""
    x = structure.join(context.withColumnRenamed("family", "component").drop("members"), "component")
    any_kind = F.lit(not kinds)
    for k in kinds or []:
        any_kind = any_kind | (F.col(f"{k}_links") > 0)
    return x.where((F.col("members") >= min_size) & any_kind & (F.col("avg_similarity") >= min_similarity) & (F.col("concentration") >= min_concentration))
