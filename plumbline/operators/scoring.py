"""Composite scores of reviews and places; evidence that is absent adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import CONFIG, CoordinatedConfig, TemplatedConfig, WeightConfig
from plumbline.functions.num import band, clamp, rnd, total
from plumbline.functions.text import squeeze
from plumbline.operators import reuse, reviewers, temporal, texts
from plumbline.session import materialise


def templated_scores(rv: DataFrame, cfg: TemplatedConfig = CONFIG.templated, peers: DataFrame | None = None) -> DataFrame:
    """(review_id, place_id, templated, active, band): weighted sum of seven signals of reuse within the place, how
    many of them reach a half, and HIGH only where at least three do.

    ``peers``: (review_id, peers), near-identical reviews of the place by their vectors, for the places whose
    reviews all have one; the others are compared by the bigrams of their texts.
    """
    base = reuse.place_signals(texts.with_specificity(rv), cfg)
    if peers is not None:
        base = base.join(peers.select("review_id", F.col("peers").alias("by_vector")), "review_id", "left").withColumn("peers", F.coalesce("by_vector", "peers"))
    s = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    signals = [
        (cfg.phrase, s("phrase_reuse")), (cfg.peers, clamp((s("peers") - 3) / 3.0, 0.0, 1.0)), (cfg.structure, s("structure")),
        (cfg.unspecific, clamp((50 - F.col("spec")) / 50, 0.0, 1.0)), (cfg.detail, s("low_unique_detail")), (cfg.style, s("uniformity")), (cfg.temporal, s("temporal")),
    ]
    score = rnd(100 * total([w * v for w, v in signals]), 1)
    scored = base.select("review_id", "place_id", score.alias("templated"), total([(v >= 0.5).cast("int") for _, v in signals]).alias("active"))
    high = F.when(F.col("active") >= 3, F.lit(65.0)).otherwise(F.lit(1e9))
    return scored.withColumn("band", F.when(F.col("templated") >= high, "HIGH").when(F.col("templated") >= 40, "MEDIUM").otherwise("LOW"))


def exact_membership(rv: DataFrame) -> DataFrame:
    """Families of equal texts of a place: (review_id, family_size, avg_similarity)."""
    key = F.sha2(F.coalesce(squeeze(F.col("text")), F.lit("")), 256)
    keyed = rv.select("place_id", "review_id", key.alias("h"))
    sizes = keyed.groupBy("place_id", "h").agg(F.count(F.lit(1)).alias("family_size")).where(F.col("family_size") >= 2)
    return keyed.join(sizes, ["place_id", "h"]).select("review_id", "family_size", F.lit(1.0).alias("avg_similarity"))


def event_signals(rv: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(daily, events, shifts) as tables: every score of a place reads them again."""
    daily = materialise(temporal.daily_counts(rv), "daily")
    events = materialise(temporal.burst_events(daily), "events")
    return daily, events, materialise(temporal.rating_shifts(daily, events), "shifts")


def cluster_peers(rv: DataFrame, clusters: DataFrame, days: DataFrame, overlap: int = 3, least: float = 0.30) -> DataFrame:
    """(place_id, review_id, part) of the members of clusters (place_id, cluster_id, similarity, review_id) that are
    similar enough and have at least ``overlap`` reviews on event days; ``part``: these, of the place's reviews."""
    on = rv.select("review_id", "place_id", "day").join(days, ["place_id", "day"], "left_semi").select("review_id", F.lit(1).alias("on"))
    size = rv.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    kept = clusters.where(F.col("similarity") >= least)
    counts = kept.join(on, "review_id", "left").groupBy("place_id", "cluster_id").agg(F.count("on").alias("k")).where(F.col("k") >= overlap)
    return kept.join(counts, ["place_id", "cluster_id"]).join(size, "place_id").select("place_id", "review_id", (F.col("k") / F.col("n")).alias("part"))


def coordinated_places(
    rv: DataFrame, templated: DataFrame, families: DataFrame | None = None, clusters: DataFrame | None = None, cfg: CoordinatedConfig = CONFIG.coordinated,
    signals: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per place with the coordinated-activity score of seven components.

    ``families`` (review_id, family_size): default the equal texts of a place; families of three or more count.
    ``clusters``: see ``cluster_peers``; without them that component is 0.
    """
    daily, events, shifts = signals or event_signals(rv)
    own = rv.select("review_id", "place_id").where("place_id IS NOT NULL")
    n = own.groupBy("place_id").agg(F.count(F.lit(1)).alias("reviews"))
    families = exact_membership(rv) if families is None else families
    parts = [
        events.groupBy("place_id").agg(clamp(F.max("z_score") / 10, 0.0, 1.0).alias("volume")),
        shifts.groupBy("place_id").agg(clamp(F.max("jsd") / 0.3, 0.0, 1.0).alias("rating")),
        own.join(families.where("family_size >= 3").select("review_id").distinct(), "review_id", "left_semi").groupBy("place_id").agg(F.count(F.lit(1)).alias("dup")),
        temporal.gap_signal(daily).select("place_id", F.col("temporal_density").alias("temporal")),
        templated.groupBy("place_id").agg(F.count_if(F.col("templated") >= 65).alias("tpl")),
        reviewers.top_reviewer_share(rv).select("place_id", F.col("top_share").alias("overlap")),
    ]
    if clusters is not None:
        parts.append(cluster_peers(rv, clusters, temporal.event_days(events, shifts)).groupBy("place_id").agg(F.max("part").alias("semantic")))
    out = n
    for part in parts:
        out = out.join(part, "place_id", "left")
    s = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in out.columns else F.lit(0.0)
    score = (
        cfg.volume * s("volume") + cfg.rating * s("rating") + cfg.semantic * s("semantic") + cfg.duplicate * s("dup") / F.col("reviews") + cfg.temporal * s("temporal")
        + cfg.template * s("tpl") / F.col("reviews") + cfg.overlap * s("overlap")
    )
    return out.select("place_id", "reviews", rnd(clamp(100 * score, 0.0, 100.0), 1).alias("coordinated")).withColumn("band", band(F.col("coordinated"), 35, 65))


def review_evidence(
    rv: DataFrame, templated: DataFrame, families: DataFrame | None = None, clusters: DataFrame | None = None, signals: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(review_id, duplicate, templated_p, coordinated): graded probabilities of each review, 0 to 1.

    ``families`` (review_id, family_size, avg_similarity) of at least three count, default the equal texts of a
    place; ``clusters`` as in ``coordinated_places``.
    """
    daily, events, shifts = signals or event_signals(rv)
    families = exact_membership(rv) if families is None else families
    strength = temporal.agreed_strengths(events, shifts)
    days = temporal.event_days(events, shifts)
    marked = days.withColumn("on_event", F.lit(1))
    alike = rnd(F.least(F.lit(1.0), F.col("family_size") / 5.0) * clamp(F.col("avg_similarity"), 0.5, 1.0), 3)
    dup = families.where("family_size >= 3").groupBy("review_id").agg(F.max(alike).alias("duplicate"))
    busy = daily.join(marked, ["place_id", "day"]).groupBy("place_id").agg(F.sum("n").alias("event_reviews"))
    count = rv.groupBy("place_id").agg(F.count(F.lit(1)).alias("place_reviews"))
    x = (
        rv.select("review_id", "place_id", "day")
        .join(strength, ["place_id", "day"], "left").join(marked, ["place_id", "day"], "left")
        .join(busy, "place_id", "left").join(count, "place_id", "left")
        .join(dup, "review_id", "left").join(templated.select("review_id", "templated"), "review_id", "left")
    )
    peer = F.lit(0.0)
    if clusters is not None:
        x = x.join(cluster_peers(rv, clusters, days).select("review_id", F.lit(0.5).alias("peer")).distinct(), "review_id", "left")
        peer = F.coalesce("peer", F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    event = rnd(z("burst") * (0.5 + 0.5 * z("shift")), 3)
    pool = F.greatest(F.lit(0.0), z("event_reviews") - z("on_event"))
    dense = F.when(z("event_reviews") > 0, rnd(0.5 * z("on_event") + 0.5 * F.least(F.lit(1.0), pool / F.col("place_reviews")), 3)).otherwise(0.0)
    tpl = rnd(z("templated") / 100, 3)
    text = F.greatest(z("duplicate"), tpl)
    p = 0.35 * event + 0.30 * text + 0.20 * peer + 0.15 * dense
    return x.select("review_id", z("duplicate").alias("duplicate"), tpl.alias("templated_p"), rnd(F.least(F.lit(1.0), p), 3).alias("coordinated"))


def review_weights(rv: DataFrame, evidence: DataFrame, as_of: str, cfg: WeightConfig = CONFIG.weight, text_share: float = 0.30) -> DataFrame:
    """(review_id, place_id, rating, weight): trust in [least, most]; ``as_of`` takes the place of today."""
    rv = texts.with_specificity(rv)
    exp_ = materialise(reviewers.category_experience(rv), "experience")
    rel = materialise(reviewers.reviewer_relevance(rv, experience=exp_), "relevance")
    q = rv.select("review_id", "reviewer_id", "place_id", "place_category", "city", "region", "rating", "day", "spec")
    r = rel.select(*[F.col(c).alias("r_" + c) for c in ("reviewer_id", "place_category", "city", "region")], "relevance")
    same = [F.col(c).eqNullSafe(F.col("r_" + c)) for c in ("place_category", "city", "region")]
    x = q.join(exp_, ["reviewer_id", "place_category"], "left").join(r, (F.col("reviewer_id") == F.col("r_reviewer_id")) & same[0] & same[1] & same[2], "left").join(evidence, "review_id", "left")
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), "day"))
    recency = F.when(F.col("day").isNotNull(), F.pow(F.lit(0.5), age / cfg.half_life)).otherwise(0.0)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    quality = cfg.specificity * F.col("spec") / 100 + cfg.category * z("category_experience") / 100 + cfg.relevance * z("relevance") / 100 + cfg.recency * recency
    reuse = rnd(text_share * F.greatest(z("duplicate"), z("templated_p")), 3)
    resid = F.greatest(F.lit(0.0), rnd(z("coordinated") - reuse, 3))
    penalty = cfg.duplicate * z("duplicate") + cfg.templated * z("templated_p") + cfg.coordinated * resid
    raw = 1 + cfg.rise * F.greatest(F.lit(0.0), quality - cfg.neutral) - penalty
    return x.select("review_id", "place_id", "rating", rnd(clamp(raw, cfg.least, cfg.most), 4).alias("weight"))


def weighted_rating(weights: DataFrame) -> DataFrame:
    """Per place: raw and weighted mean rating, their difference and the shares of low and high weights."""
    rated = weights.where("rating IS NOT NULL AND place_id IS NOT NULL")
    w, x = F.sum(F.col("rating") * F.col("weight")) / F.sum("weight"), F.avg("rating")
    n = F.count(F.lit(1))
    return rated.groupBy("place_id").agg(
        n.alias("rated"), rnd(x, 2).alias("raw"), rnd(w, 2).alias("weighted"), rnd(w - x, 3).alias("delta"),
        rnd(F.avg((F.col("weight") < 0.6).cast("int")), 4).alias("low_share"), rnd(F.avg((F.col("weight") > 1.2).cast("int")), 4).alias("high_share"),
        F.when(n >= 20, "HIGH").when(n >= 5, "MEDIUM").otherwise("LOW").alias("confidence"),
    )
