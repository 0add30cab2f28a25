"""Comparing scores with human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.num import ratio, rnd

# The verdicts of the label file.
ENUMS = {
    "templated_label": ["organic", "templated", "uncertain"],
    "specificity_label": ["low", "medium", "high", "uncertain"],
    "duplicate_label": ["unique", "duplicate", "uncertain"],
    "sample_type": ["evaluation", "challenge"],
    "sampling_stratum": ["random", "high", "medium", "low", "duplicate"],
}


def clean_labels(labels: DataFrame, others: list[str] | None = None) -> DataFrame:
    """Labels, with the columns ``others`` as they are, with trimmed lower-case verdicts, unknown ones null with a warning, and consistency warnings."""
    cleaned = {c: F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in ENUMS}
    plain = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("review_id", "template_group_id", "duplicate_group_id", "annotator_id")}
    x = labels.select(*[v.alias(c) for c, v in plain.items()], *[v.alias(c) for c, v in cleaned.items()], *(others or [])).where("review_id IS NOT NULL")
    wrong = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.concat(F.lit(f"unknown {c}: "), F.col(c))) for c, v in ENUMS.items()]
    x = x.withColumn("w", F.array_compact(F.array(*wrong)))
    for c, v in ENUMS.items():
        x = x.withColumn(c, F.when(F.col(c).isin(v), F.col(c)))
    group, dup = F.col("duplicate_group_id").isNotNull(), F.coalesce(F.col("duplicate_label") == "duplicate", F.lit(False))
    rules = F.array_compact(F.array(
        F.when(dup & ~group, F.lit("duplicate without group")), F.when(group & ~dup, F.lit("group without duplicate")),
        F.when(F.col("template_group_id").isNotNull() & (F.col("templated_label") == "organic"), F.lit("template group on organic")),
    ))
    return x.withColumn("warnings", F.size(F.concat("w", rules))).drop("w")


def threshold_sweep(pairs: DataFrame, score: str, truth: Column, step: int = 5) -> DataFrame:
    """Confusion counts and rates for thresholds 0, step, ..., 100. The scores are counted per step first, so the
    sweep joins a table of at most 102 rows."""
    bins = pairs.select(truth.alias("t"), F.least(F.floor(F.col(score) / step), F.lit(100 // step)).cast("int").alias("b")).where("t IS NOT NULL")
    counts = bins.groupBy("b").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("n"))
    grid = pairs.sparkSession.range(0, 100 // step + 1).select(F.col("id").cast("int").alias("i"))
    at = grid.join(F.broadcast(counts)).groupBy("i").agg(  # at most 21 x 21 rows
        F.sum(F.when(F.col("b") >= F.col("i"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("b") >= F.col("i"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("b") < F.col("i"), F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("b") < F.col("i"), F.col("n")).otherwise(0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return at.select(
        (F.col("i") * step).alias("threshold"), "tp", "fp", "fn", "tn", rnd(ratio(tp, tp + fp), 4).alias("precision"), rnd(ratio(tp, tp + fn), 4).alias("recall"),
        rnd(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"), rnd(ratio(fp, fp + tn), 4).alias("fpr"), rnd(ratio(fn, fn + tp), 4).alias("fnr"),
    )


def _average_ranks(pairs: DataFrame, x: str) -> DataFrame:
    """(x, rank) from the counts per value; the window runs over distinct values only."""
    counts = pairs.groupBy(x).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(x)
    return counts.select(x, (F.sum("c").over(w) - (F.col("c") - 1) / 2).alias("rank_" + x))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null below three pairs or without variance."""
    p = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = p.join(_average_ranks(p, x), x).join(_average_ranks(p, y), y)
    a, b = F.col("rank_" + x), F.col("rank_" + y)
    ok = (F.count(F.lit(1)) >= 3) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0)
    return r.agg(F.count(F.lit(1)).alias("n"), F.when(ok, rnd(F.covar_pop(a, b) / F.sqrt(F.var_pop(a) * F.var_pop(b)), 4)).alias("spearman"))


def crosstab(pairs: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return pairs.where(F.col(row).isNotNull()).groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def coverage(labels: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) for each verdict column; null verdicts count as ``missing``."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("missing")).alias("value")) for c in columns])
    return labels.select(F.explode(cells).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def pair_metrics(human: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pair-level agreement of two groupings (review_id, group), on labelled reviews.

    Pairs are counted from the sizes of groups and of their intersections, never listed.
    """
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    h = human.select("review_id", F.col("group").alias("h")).distinct()
    p = predicted.select("review_id", F.col("group").alias("p")).distinct()
    count = lambda df, k: F.coalesce(F.lit(df.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(pairs("n")).first()[0]), F.lit(0.0))
    true, found = count(h.where("h IS NOT NULL"), "h"), count(p.where("p IS NOT NULL").join(h.select("review_id").distinct(), "review_id", "left_semi"), "p")
    both = h.where("h IS NOT NULL").join(p.where("p IS NOT NULL"), "review_id").groupBy("h", "p").agg(F.count(F.lit(1)).alias("n"))
    out = both.agg(F.coalesce(pairs("n"), F.lit(0.0)).alias("tp")).select("tp", (found - F.col("tp")).alias("fp"), (true - F.col("tp")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(
        *[c.cast("long").alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))], rnd(ratio(tp, tp + fp), 4).alias("precision"), rnd(ratio(tp, tp + fn), 4).alias("recall"),
        rnd(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
    )


def score_distribution(values: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank-low percentiles per group: the value at position floor(n p) of the sorted values."""
    counts = values.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    n = F.sum("c").over(Window.partitionBy(group))
    cum = counts.withColumn("hi", F.sum("c").over(w)).withColumn("n", n)
    at = lambda p: F.min(F.when(F.col("hi") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col(value)))
    return cum.groupBy(group).agg(
        F.sum("c").alias("n"), F.min(value).alias("min"), at(0.25).alias("p25"), at(0.5).alias("median"), rnd(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 2).alias("mean"),
        at(0.75).alias("p75"), at(0.95).alias("p95"), F.max(value).alias("max"),
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    """Far specificity disagreements: the label and the band are two steps apart."""
    far = ((F.col("specificity_label") == "low") & (F.col("band") == "HIGH")) | ((F.col("specificity_label") == "high") & (F.col("band") == "LOW"))
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > 300, F.concat(F.rtrim(F.substring(text, 1, 300)), F.lit(" …"))).otherwise(text)
    return pairs.where(far).select("review_id", "annotator_id", "specificity_label", "band", "specificity", cut.alias("text"))
