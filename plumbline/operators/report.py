"""Scores held against human labels: partitions, disagreements, group agreement and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.num import band, ratio, rnd


def truncated(text: Column, most: int = 300) -> Column:
    """Trimmed text, cut at ``most`` characters with an ellipsis."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit(" …"))).otherwise(t)


def with_sample_type(labels: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """``labels`` with ``sample``: their own sample type, else that of the selection (review_id, sample_type), else ``unattributed``."""
    own = F.col("sample_type")
    if selection is not None:
        chosen = selection.groupBy("review_id").agg(F.min("sample_type").alias("__selected"))
        labels, own = labels.join(chosen, "review_id", "left"), F.coalesce(own, F.when(F.col("__selected").isin("evaluation", "challenge"), F.col("__selected")))
    return labels.withColumn("sample", F.coalesce(own, F.lit("unattributed"))).drop("__selected")


def unmatched(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Labelled ids that have no score."""
    return labels.select("review_id").distinct().join(scores.select("review_id"), "review_id", "left_anti")


def unlabelled(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """The queue: scored ids without a label."""
    return scores.select("review_id").distinct().join(labels.select("review_id"), "review_id", "left_anti")


def same_ids(a: DataFrame, b: DataFrame, key: str = "review_id") -> DataFrame:
    """One row: how many keys only one side has, and whether the sets are equal."""
    x = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return x.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def partition_metrics(pairs: DataFrame, threshold: float = 65.0) -> DataFrame:
    """Per sample type, never mixed: confusion of the templated score, its rates, and how far specificity is off.

    ``pairs``: labels with ``sample``, ``templated`` and ``specificity``. A rate without cases is null.
    """
    over, yes, no = F.col("templated") >= threshold, F.col("templated_label") == "templated", F.col("templated_label") == "organic"
    human = F.when(F.col("specificity_label") == "low", 0).when(F.col("specificity_label") == "medium", 1).when(F.col("specificity_label") == "high", 2)
    found = F.when(F.col("specificity") >= 65, 2).when(F.col("specificity") >= 40, 1).otherwise(0)
    off = F.abs(human - found)
    x = pairs.groupBy("sample").agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(over & yes).alias("tp"), F.count_if(over & no).alias("fp"), F.count_if(~over & yes).alias("fn"), F.count_if(~over & no).alias("tn"),
        F.count_if(off == 1).alias("near"), F.count_if(off == 2).alias("far"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return x.select(
        "*", rnd(ratio(tp, tp + fp), 4).alias("precision"), rnd(ratio(tp, tp + fn), 4).alias("recall"), rnd(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
        rnd(ratio(fp, fp + tn), 4).alias("fpr"), rnd(ratio(fn, fn + tp), 4).alias("fnr"),
    )


def disagreements(pairs: DataFrame, threshold: float = 65.0) -> DataFrame:
    """All kinds of disagreement, a row each: templated false positives and negatives, far specificity, missed and
    false duplicates.

    ``pairs``: labels with ``templated``, ``specificity``, ``family_size`` (null where in no family) and ``text``.
    ``sample_rank`` and the other columns give the order of the report: kind, sample, score descending, id.
    """
    level = band(F.col("specificity"), 40, 65)
    grouped = F.coalesce("family_size", F.lit(0)) >= 2
    case = lambda cond, kind, score: F.when(cond, F.struct(F.lit(kind).alias("kind"), score.cast("double").alias("score")))
    label = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    over = F.col("templated") >= threshold
    found = F.array_compact(F.array(
        case(label("templated_label", "organic") & over, "templated_false_positive", F.col("templated")),
        case(label("templated_label", "templated") & ~over, "templated_false_negative", F.col("templated")),
        case(label("specificity_label", "low") & (level == "HIGH"), "specificity_far_human_low", F.col("specificity")),
        case(label("specificity_label", "high") & (level == "LOW"), "specificity_far_human_high", F.col("specificity")),
        case(label("duplicate_label", "duplicate") & ~grouped, "duplicate_missed_group", F.lit(0.0)),
        case(label("duplicate_label", "unique") & grouped, "duplicate_false_positive", F.col("family_size")),
    ))
    rank = F.when(F.col("sample_type") == "evaluation", 0).when(F.col("sample_type") == "challenge", 1).otherwise(2)
    rows = pairs.select("review_id", "annotator_id", "sample_type", "sampling_stratum", rank.alias("sample_rank"), truncated(F.col("text")).alias("text"), F.explode(found).alias("x"))
    return rows.select("x.kind", "sample_rank", "x.score", "review_id", "annotator_id", "sample_type", "sampling_stratum", "text")


def group_agreement(human: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: human and predicted groups (review_id, group), and how many of each have a counterpart with a Jaccard
    similarity of at least ``least``. Only groups that share a review are compared."""
    h, p = (x.where("group IS NOT NULL").select("review_id", F.col("group").alias(n)).distinct() for x, n in ((human, "h"), (predicted, "p")))
    hs, ps = h.groupBy("h").agg(F.count(F.lit(1)).alias("nh")), p.groupBy("p").agg(F.count(F.lit(1)).alias("np"))
    both = h.join(p, "review_id").groupBy("h", "p").agg(F.count(F.lit(1)).alias("k")).join(hs, "h").join(ps, "p")
    close = both.where(F.col("k") >= least * (F.col("nh") + F.col("np") - F.col("k")))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    found = close.agg(F.countDistinct("h").alias("recovered_human"), F.countDistinct("p").alias("matched_predicted"))
    x = n(hs, "human_groups").crossJoin(n(ps, "predicted_groups")).crossJoin(found)  # one row each
    return x.select("*", rnd(ratio(F.col("recovered_human"), F.col("human_groups")), 4).alias("recovered_share"), rnd(ratio(F.col("matched_predicted"), F.col("predicted_groups")), 4).alias("matched_share"))


def progress(labels: DataFrame) -> DataFrame:
    """Labelled reviews by sample type."""
    return labels.groupBy(F.coalesce("sample_type", F.lit("unattributed")).alias("sample_type")).agg(F.countDistinct("review_id").alias("labelled"))
