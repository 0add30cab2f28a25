"""Graph operators as DataFrame iterations; every round ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.num import rnd
from plumbline.session import drop_materialised, materialise


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node linked directly or indirectly.

    Alternating stars: every node links its larger neighbours to its smallest one, then its smaller ones.
    Loops end when the edges no longer change, told by a count and a checksum.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    now = materialise(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "stars")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u != m").select(F.col("m").alias("u"), F.col("u").alias("v")).union(low.select(F.col("m").alias("u"), "v")).distinct()
        after = materialise(small, "stars")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_materialised(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def bipartite_core(rows: DataFrame, left: str, right: str, left_rows: int = 10, right_rows: int = 3, right_lefts: int = 2, rounds: int = 1000) -> DataFrame:
    """The rows that remain when lefts with fewer than ``left_rows`` rows and rights with fewer than
    ``right_rows`` rows or ``right_lefts`` different lefts are removed again and again."""
    now = materialise(rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()), "core")
    count = now.count()
    for _ in range(rounds):
        l = now.groupBy(left).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= left_rows).select(left)  # noqa: E741
        kept = now.join(l, left, "left_semi")
        r = kept.groupBy(right).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(left).alias("k")).where((F.col("n") >= right_rows) & (F.col("k") >= right_lefts)).select(right)
        after = materialise(kept.join(r, right, "left_semi").select(*rows.columns), "core")
        drop_materialised(now)
        now, before = after, count
        count = now.count()
        if count == before:
            return now
    raise RuntimeError("the core did not settle")


def best_links(edges: DataFrame) -> DataFrame:
    """(u, v, kind, score), u < v: of several matches of a pair the exact one, which scores 1, else the one with the
    highest score; ties go to fuzzy, then near, then semantic."""
    pair = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "kind", F.when(F.col("kind") == "exact", 1.0).otherwise(F.col("score")).alias("score"))
    rank = F.when(F.col("kind") == "exact", 4).when(F.col("kind") == "fuzzy", 3).when(F.col("kind") == "near", 2).otherwise(1)
    order = F.struct((F.col("kind") == "exact").alias("x"), F.coalesce("score", F.lit(-1.0)).alias("s"), rank.alias("k"))
    return pair.where("u != v").groupBy("u", "v").agg(F.max_by(F.struct("kind", "score"), order).alias("b")).select("u", "v", "b.*")


def families(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(review_id, family, family_size, avg_similarity) of every node: its component, the nodes in it and the mean
    score of its links (0 where none has a score)."""
    links = best_links(edges).join(components.select(F.col("node").alias("u"), F.col("component").alias("family")), "u")
    millionths = F.sum(F.floor(F.col("score") * 1e6 + 0.5))  # whole numbers, so the mean does not depend on their order
    mean = links.groupBy("family").agg(rnd(F.coalesce(millionths / F.count("score") / 1e6, F.lit(0.0)), 4).alias("avg_similarity"))
    sizes = components.groupBy(F.col("component").alias("family")).agg(F.count(F.lit(1)).alias("family_size"))
    return components.select(F.col("node").alias("review_id"), F.col("component").alias("family")).join(sizes.join(mean, "family", "left"), "family").select(
        "review_id", "family", "family_size", "avg_similarity"
    )


def family_structure(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Per component: members, links, density and links by kind.

    ``edges``: (u, v, kind, score) in any order and with repeats; see ``best_links``.
    """
    links = best_links(edges).join(components.select(F.col("node").alias("u"), "component"), "u")
    per = links.groupBy("component").agg(
        F.count(F.lit(1)).alias("links"), *[F.count_if(F.col("kind") == k).alias(f"{k}_links") for k in ("exact", "near", "fuzzy", "semantic")],
    )
    members = components.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    possible = F.col("members") * (F.col("members") - 1) / 2
    lexical = F.col("exact_links") + F.col("near_links") + F.col("fuzzy_links")
    return members.join(per, "component").select(
        "component", "members", "links", F.floor(F.col("links") / possible * 10000 + 0.5).alias("density_e4"), "exact_links", "near_links", "fuzzy_links", "semantic_links",
        ((F.col("members") >= 3) & (F.col("links") < possible)).alias("transitive"),
        ((F.col("members") >= 3) & (F.col("links") * 2 < possible)).alias("sparse"),
        F.when(F.col("semantic_links") == 0, "Repeated-text family").when(lexical == 0, "Semantic similarity family").otherwise("Mixed similarity family").alias("label"),
    )
