"""What a reviewer's whole history says: metrics, experience, familiarity and relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import CONFIG, ExperienceConfig, FamiliarityConfig, RelevanceConfig
from plumbline.functions.num import clamp, log_saturate, rnd
from plumbline.operators.temporal import STARS
from plumbline.operators.texts import with_specificity


def _span() -> Column:
    return F.datediff(F.max("day"), F.min("day"))


def reviewer_metrics(rv: DataFrame) -> DataFrame:
    """One row per reviewer: counts, rating mean, spread and entropy, text length, specificity, period."""
    n = F.count("rating")
    share = [F.count_if(F.col("rating") == s) / n for s in STARS]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0)) / F.log2(F.lit(5.0))
    base = with_specificity(rv).groupBy("reviewer_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        rnd(F.avg("rating"), 2).alias("rating_mean"),
        F.when(n < 2, 0.0).otherwise(F.stddev_pop("rating")).alias("std"),
        F.when(n > 0, entropy).alias("entropy"),
        rnd(F.avg(F.length(F.coalesce("text", F.lit("")))), 1).alias("text_length_mean"),
        F.countDistinct("place_category").alias("category_count"),
        F.countDistinct("city").alias("city_count"),
        F.when(F.count("day") == 1, 1).when(F.count("day") > 1, F.greatest(F.lit(1), _span())).alias("active_period_days"),
        rnd(F.avg("spec"), 1).alias("specificity_mean"),
    )
    return base.select(
        "reviewer_id", "review_count", "rating_mean", rnd(F.col("std"), 3).alias("rating_std"), rnd(F.coalesce("entropy", F.lit(0.0)), 3).alias("rating_entropy"),
        "text_length_mean", "category_count", "city_count", "active_period_days", "specificity_mean",
        rnd(F.coalesce(1 - F.col("entropy"), F.lit(0.0)), 3).alias("review_diversity"),
        rnd(F.greatest(F.lit(0.0), 1 - rnd(F.col("std"), 3) / 2), 3).alias("review_consistency"),
    )


def flag_ratios(rv: DataFrame, flagged: DataFrame, name: str) -> DataFrame:
    """Share of each reviewer's reviews among the flagged review ids."""
    marked = rv.select("reviewer_id", "review_id").join(flagged.select("review_id").distinct().withColumn("f", F.lit(1)), "review_id", "left")
    return marked.groupBy("reviewer_id").agg(rnd(F.count("f") / F.count(F.lit(1)), 3).alias(name))


def category_experience(rv: DataFrame, cfg: ExperienceConfig = CONFIG.experience) -> DataFrame:
    """(reviewer_id, place_category, category_experience) for every category that a reviewer has reviewed."""
    total = rv.groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("total"))
    per = rv.where("place_category IS NOT NULL").groupBy("reviewer_id", "place_category").agg(
        F.count(F.lit(1)).alias("n"), F.count("day").alias("dated"), _span().alias("span"), F.countDistinct("place_id").alias("places")
    )
    active = F.when(F.col("dated") >= 2, F.least(F.lit(1.0), F.col("span") / 730.0)).otherwise(0.0)
    value = 100 * (
        cfg.count * log_saturate(F.col("n"), cfg.log_scale)
        + cfg.share * (F.col("n") / F.col("total")) * log_saturate(F.col("total"), cfg.log_scale)
        + cfg.active * active
        + cfg.diversity * F.least(F.lit(1.0), F.col("places") / 5.0)
    )
    return per.join(total, "reviewer_id").select("reviewer_id", "place_category", rnd(clamp(value, 0.0, 100.0), 1).alias("category_experience"))


def local_familiarity(rv: DataFrame, cfg: FamiliarityConfig = CONFIG.familiarity) -> DataFrame:
    """(reviewer_id, city, region, local_familiarity) for every location that a reviewer has reviewed.

    The city component takes the reviews of that city, the region component those of the same region in
    other cities (a null city is another city); both are merged from one row per reviewer, city, region and place.
    """
    unit = rv.groupBy("reviewer_id", "city", "region", "place_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("day").alias("dated"), F.min("day").alias("a"), F.max("day").alias("b")
    )
    merged = [
        F.sum("n").alias("n"), F.sum("dated").alias("dated"), F.datediff(F.max("b"), F.min("a")).alias("span"), F.countDistinct("place_id").alias("places"),
    ]
    component = 100 * (
        cfg.diversity * F.least(F.lit(1.0), F.col("places") / 3.0)
        + cfg.activity * log_saturate(F.col("n"), cfg.log_scale)
        + cfg.duration * F.when(F.col("dated") >= 2, F.least(F.lit(1.0), F.col("span") / 365.0)).otherwise(0.0)
    )
    asked = unit.select("reviewer_id", "city", "region").distinct().where("city IS NOT NULL OR region IS NOT NULL")
    own = unit.where("city IS NOT NULL").groupBy("reviewer_id", "city").agg(*merged).select("reviewer_id", "city", component.alias("c"))
    rest = unit.select("reviewer_id", "region", F.col("city").alias("other"), "place_id", "n", "dated", "a", "b")
    around = (
        asked.where("region IS NOT NULL").join(rest, ["reviewer_id", "region"]).where("NOT (city <=> other)")
        .groupBy("reviewer_id", "city", "region").agg(*merged).select("reviewer_id", F.col("city").alias("city2"), F.col("region").alias("region2"), component.alias("r"))
    )
    x = asked.join(own, ["reviewer_id", "city"], "left").alias("x")
    y = around.withColumnRenamed("reviewer_id", "reviewer2")
    both = x.join(y, (F.col("x.reviewer_id") == F.col("reviewer2")) & F.col("x.region").eqNullSafe(F.col("region2")) & F.col("x.city").eqNullSafe(F.col("city2")), "left")
    value = F.when(F.col("c").isNotNull() & F.col("r").isNotNull(), 0.75 * F.col("c") + 0.25 * F.col("r")).otherwise(F.coalesce("c", "r", F.lit(0.0)))
    return both.select("reviewer_id", "city", "region", rnd(clamp(value, 0.0, 100.0), 1).alias("local_familiarity"))


def reviewer_relevance(rv: DataFrame, cfg: RelevanceConfig = CONFIG.relevance, experience: DataFrame | None = None) -> DataFrame:
    """(reviewer_id, place_category, city, region, relevance) for the combinations that occur.

    Depends on these keys only, so it is computed once for each and joined to reviews where needed.
    """
    h = with_specificity(rv).groupBy("reviewer_id").agg(
        F.avg("spec").alias("spec"), F.when(F.count("rating") < 2, 0.0).otherwise(F.stddev_pop("rating")).alias("std"), F.count(F.lit(1)).alias("total")
    )
    keys = rv.select("reviewer_id", "place_category", "city", "region").distinct()
    exp_ = category_experience(rv) if experience is None else experience
    loc = local_familiarity(rv).select(
        F.col("reviewer_id").alias("l_r"), F.col("city").alias("l_c"), F.col("region").alias("l_g"), "local_familiarity"
    )
    k = keys.join(exp_, ["reviewer_id", "place_category"], "left").join(h, "reviewer_id")
    k = k.join(loc, (F.col("reviewer_id") == F.col("l_r")) & F.col("city").eqNullSafe(F.col("l_c")) & F.col("region").eqNullSafe(F.col("l_g")), "left")
    value = 100 * (
        cfg.category * F.coalesce("category_experience", F.lit(0.0)) / 100
        + cfg.specificity * F.col("spec") / 100
        + cfg.consistency * F.greatest(F.lit(0.0), 1 - F.col("std") / 2)
        + cfg.local * F.coalesce("local_familiarity", F.lit(0.0)) / 100
        + cfg.depth * F.least(F.lit(1.0), F.log10(F.col("total") + 1) / 2)
    )
    return k.select("reviewer_id", "place_category", "city", "region", rnd(clamp(value, 0.0, 100.0), 1).alias("relevance"))


def top_reviewer_share(rv: DataFrame) -> DataFrame:
    per = rv.groupBy("place_id", "reviewer_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("place_id").agg(F.sum("n").alias("reviews"), rnd(F.max("n") / F.sum("n"), 4).alias("top_share"))
