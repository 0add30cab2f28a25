"""Queries of the training-text problems (2, 5, 7, 8, 9 and 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.num import rnd
from plumbline.functions.text import token_count
from plumbline.llm import components, mixing, neardup, packing, queries_sql, splitting, vectors
from plumbline.session import table

CAPACITY = 2048
PIECE_LIMIT = 512
PIECE_OVERLAP = 64


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_groups(table(spark, d, "duplicate_edges"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    lists = components.group_lists(p2_found(spark, d))
    return lists.select("group_id", "part", "group_size", F.array_join("review_ids", " ").alias("review_ids"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "embeddings_cache").where("model_name = 'minilm-multi-384'")
    return vectors.similar_vectors(cache, "review_id", "embedding", 384, k=5, min_cosine=0.8)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbour_pairs(_p5(spark, d), "review_id")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).withColumn("cosine", rnd(F.round("cosine", 9), 6))


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.similar_texts(table(spark, d, "reviews"), "review_id", "text", threshold=0.7, min_chars=100)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(*_p7(spark, d), "review_id")


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per text of at least 100 characters: review and its group, named by the smallest review of the group."""
    return neardup.group_members(*_p7(spark, d), "review_id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), "doc_id", "n_tokens", CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).where("piece_no = 2").select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d)


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the containers, whatever the order of the items; one row."""
    return packing.summary(_p8(spark, d), "doc_id", CAPACITY)


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"), "doc_id", "n_tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1].where("capped").select("source")


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1]


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    """The part of the report that no draw decides."""
    r = _p9(spark, d)[1]
    return r.select("source", "tokens", rnd(F.col("target_tokens"), 2).alias("target_tokens"), rnd(F.col("expected_copies"), 6).alias("expected_copies"), "capped")


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every draw: documents of each source, those beyond their cap, and whether the tokens of the
    source miss their target by less than a document of its mean size."""
    selection, report = _p9(spark, d)
    per = selection.join(F.broadcast(report.select("source", "max_repeats", "target_tokens")), "source")  # a row per target
    off = F.abs(F.sum(F.col("n_tokens") * F.col("copies")) - F.first("target_tokens"))
    return per.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("beyond_cap"), (off < F.avg("n_tokens")).alias("held")
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_texts(table(spark, d, "documents"), "doc_id", "text", PIECE_LIMIT, 0)
    return pieces.groupBy("doc_id").agg(F.max("forced").alias("forced_cut"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "documents"), "doc_id", "text", PIECE_LIMIT, PIECE_OVERLAP)


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_groups, p5_found, p5_neighbours, p7_found, p7_groups, p8_found, p8_containers, p8_check, p9_found, p9_selection, p9_report, p9_plan, p9_check,
        p10_found, p10_pieces,
    )
}
ORACLES = dict(queries_sql.ORACLES)
