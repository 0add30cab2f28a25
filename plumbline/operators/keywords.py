"""TF-IDF keywords of groups of texts, all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import lexicon
from plumbline.functions.num import rnd
from plumbline.functions.text import WORD
from plumbline.operators.texts import ngrams


def all_words(text: Column) -> Column:
    """Lower-case words of two characters or more, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def words(text: Column) -> Column:
    """``all_words`` without stop words."""
    return F.filter(all_words(text), lambda w: ~w.isin(lexicon.STOP))


def term_weights(docs: DataFrame, group: str, features: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(weights, sizes): (group, doc, term, w) with L2-normalised sublinear TF-IDF, and documents per group.

    The ``features`` most frequent terms of a group count (ties: the smaller term). Blank texts are no
    documents; documents without a counted term stay in the number of documents.
    """
    live = docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    sizes = live.groupBy(group).agg(F.count(F.lit(1)).alias("docs"))
    kept = live.select(group, "doc", words(F.col("text")).alias("t"))
    tf = kept.select(group, "doc", F.explode(F.concat("t", ngrams(F.col("t"), 2))).alias("term")).groupBy(group, "doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    w = Window.partitionBy(group).orderBy(F.desc("total"), "term")
    vocabulary = stats.withColumn("r", F.row_number().over(w)).where(F.col("r") <= features).join(sizes, group)
    idf = F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1
    raw = tf.join(vocabulary.select(group, "term", idf.alias("idf")), [group, "term"]).withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(group, "doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, [group, "doc"]).select(group, "doc", "term", (F.col("x") / F.col("norm")).alias("w")), sizes


def keywords(docs: DataFrame, group: str, top: int = 15) -> DataFrame:
    """(group, term, score, rank): the terms with the largest mean weight; ties: the smaller term.

    A group with one text that is not blank has the shares of that text's words instead, stop words included;
    ties: the word that comes first.
    """
    weights, sizes = term_weights(docs, group)
    mean = weights.groupBy(group, "term").agg(F.sum("w").alias("s")).join(sizes.where("docs >= 2"), group)
    scored = mean.select(group, "term", rnd(F.col("s") / F.col("docs"), 6).alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    several = scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return several.unionByName(_single(docs, group, sizes, top))


def _single(docs: DataFrame, group: str, sizes: DataFrame, top: int) -> DataFrame:
    live = docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).join(sizes.where("docs = 1").select(group), group)
    found = live.select(group, all_words(F.col("text")).alias("t"))
    spots = found.select(group, F.size("t").alias("total"), F.posexplode("t").alias("at", "term"))
    shares = spots.groupBy(group, "term", "total").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "at")
    ranked = shares.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select(group, "term", rnd(F.col("n") / F.col("total"), 6).alias("score"), "rank")


def emerging(docs: DataFrame, group: str, anchor: Column, reference_days: int = 90, recent_days: int = 30, top: int = 10) -> DataFrame:
    """Terms whose mean weight grew from the reference period to the recent one, with the ratio.

    Both periods include the day between them. ``anchor``: the last day of the recent period, per row.
    """
    age = F.datediff(anchor, F.col("day"))
    sides = F.array_compact(F.array(
        F.when(age.between(recent_days, recent_days + reference_days), F.lit("ref")), F.when(age.between(0, recent_days), F.lit("new"))
    ))
    both = docs.where("text IS NOT NULL").withColumn("side", F.explode(sides)).withColumn("doc", F.concat_ws("#", "side", "doc"))
    weights, _ = term_weights(both.select(group, "doc", "text"), group)
    sizes = both.where(F.length(F.trim("text")) > 0).groupBy(group).agg(F.count_if(F.col("side") == "ref").alias("n_ref"), F.count_if(F.col("side") == "new").alias("n_new"))
    new = F.col("doc").startswith("new#")
    sums = weights.groupBy(group, "term").agg(F.sum(F.when(new, F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(~new, F.col("w")).otherwise(0.0)).alias("b"))
    rated = sums.join(sizes.where("n_ref > 0 AND n_new > 0"), group)
    ratio = (F.col("a") / F.col("n_new") + 1e-9) / (F.col("b") / F.col("n_ref") + 1e-9)
    # a term that the reference period lacks has no stable ratio, so those come by their recent weight
    out = rated.select(group, "term", F.when(F.col("b") > 0, rnd(ratio, 4)).alias("ratio"), rnd(F.col("a") / F.col("n_new"), 6).alias("recent"), (ratio > 1).alias("grown"))
    w = Window.partitionBy(group).orderBy(F.col("ratio").isNotNull(), F.desc("ratio"), F.desc("recent"), "term")
    return out.where("grown").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("grown")
