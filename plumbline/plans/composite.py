"""Composite scores, label validation, sampling, graph and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.timeparse import strip
from plumbline.operators import graph, sampling, scoring, texts, topics, validation, vectors
from plumbline.plans import composite_sql
from plumbline.plans.reference import rv
from plumbline.session import materialise, table

QUERIES = {}
AS_OF = "2025-01-01"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _reviews(spark, d, *columns):
    """The review view, all of it or these columns, with specificity as a table: the composite scores read it many times."""
    return materialise(texts.specificity_table(rv(spark, d, *columns)), "reviews")


def _complete(spark, d, r, least):
    cache = table(spark, d, "embeddings_cache").where("model_name = 'minilm-multi-384'")
    return topics.complete_places(r, cache.where(F.size("embedding") == 384).groupBy("review_id").agg(F.min("embedding").alias("embedding")), least)


def _scored(spark, d, *columns):
    """(reviews, templated, families, clusters, signals): what the composite scores have in common. ``columns``: those of the reviews that are needed besides."""
    r = _reviews(spark, d, *dict.fromkeys(["place_id", "rating", "text", "day", *columns]))
    complete = materialise(_complete(spark, d, r, 2), "complete")
    # as tables, so what is small is known to be before the reviews are shuffled to it
    peers, clusters = materialise(topics.semantic_peers(complete), "peers"), materialise(topics.topic_clusters(complete), "clusters")
    templated = materialise(scoring.templated_scores(r, peers=peers), "templated")
    edges = _edges(spark, d)
    components = materialise(graph.connected_components(edges, "u", "v"), "components")
    families = materialise(graph.families(edges, components), "families")
    return r, templated, families, clusters, scoring.event_signals(r)


@query
def templated_scores(spark, d):
    r = _reviews(spark, d, "place_id", "text", "day")
    return scoring.templated_scores(r, peers=topics.semantic_peers(_complete(spark, d, r, 2)))


@query
def coordinated_places(spark, d):
    r, templated, families, clusters, signals = _scored(spark, d, "reviewer_id")
    return scoring.coordinated_places(r, templated, families, clusters, signals=signals)


@query
def review_evidence(spark, d):
    r, templated, families, clusters, signals = _scored(spark, d)
    return scoring.review_evidence(r, templated, families, clusters, signals)


def _weights(spark, d):
    r, templated, families, clusters, signals = _scored(spark, d, "reviewer_id", "place_category", "city", "region")
    evidence = materialise(scoring.review_evidence(r, templated, families, clusters, signals), "evidence")
    return scoring.review_weights(r, evidence, AS_OF)


@query
def review_weights(spark, d):
    return _weights(spark, d)


@query
def weighted_rating(spark, d):
    return scoring.weighted_rating(_weights(spark, d))


@query
def place_phrases(spark, d):
    return topics.representative_phrases(rv(spark, d, "place_id", "text").where("place_id IS NOT NULL"), "place_id")


@query
def complete_places(spark, d):
    return _complete(spark, d, rv(spark, d, "place_id"), 1).select("place_id", "review_id")


def _edges(spark, d):
    e = table(spark, d, "duplicate_edges").select(strip(F.col("review_id_a")).alias("u"), strip(F.col("review_id_b")).alias("v"), "kind", "score")
    return e.where("u != '' AND v != '' AND u != v AND kind IS NOT NULL")


@query
def family_components(spark, d):
    return graph.connected_components(_edges(spark, d), "u", "v")


@query
def family_structure(spark, d):
    return graph.family_structure(_edges(spark, d), graph.connected_components(_edges(spark, d), "u", "v"))


@query
def kcore_reviews(spark, d):
    return graph.bipartite_core(rv(spark, d, "place_id", "reviewer_id"), "place_id", "reviewer_id")


def _labels(spark, d):
    return validation.clean_labels(table(spark, d, "human_labels"))


@query
def cleaned_labels(spark, d):
    return _labels(spark, d)


def _labelled(spark, d):
    scores = texts.specificity_scores(rv(spark, d, "text"))
    return _labels(spark, d).join(scores, "review_id")


@query
def confusion_sweep(spark, d):
    truth = F.when(F.col("templated_label") == "templated", True).when(F.col("templated_label") == "organic", False)
    scores = scoring.templated_scores(_reviews(spark, d)).select("review_id", "templated")
    return validation.threshold_sweep(_labels(spark, d).join(scores, "review_id"), "templated", truth)


@query
def specificity_spearman(spark, d):
    rank = F.when(F.col("specificity_label") == "low", 0).when(F.col("specificity_label") == "medium", 1).when(F.col("specificity_label") == "high", 2)
    return validation.spearman(_labelled(spark, d).select(rank.alias("human"), "specificity"), "human", "specificity")


@query
def specificity_crosstab(spark, d):
    return validation.crosstab(_labelled(spark, d).where("specificity_label != 'uncertain'"), "specificity_label", "band", ["LOW", "MEDIUM", "HIGH"])


@query
def label_coverage(spark, d):
    return validation.coverage(_labels(spark, d), ["templated_label", "specificity_label", "duplicate_label", "sample_type", "sampling_stratum"])


@query
def duplicate_pair_metrics(spark, d):
    human = _labels(spark, d).groupBy("review_id").agg(F.min(F.when(F.col("duplicate_label") == "duplicate", F.col("duplicate_group_id"))).alias("group"))
    found = graph.connected_components(_edges(spark, d), "u", "v").select(F.col("node").alias("review_id"), F.col("component").alias("group"))
    return validation.pair_metrics(human, found)


@query
def score_distribution(spark, d):
    return validation.score_distribution(_labelled(spark, d), "specificity_label", "specificity")


@query
def specificity_disagreements(spark, d):
    return validation.disagreements(_labelled(spark, d).join(rv(spark, d, "text").select("review_id", "text"), "review_id"))


@query
def evaluation_sample(spark, d):
    return sampling.simple_sample(rv(spark, d, "place_id"), "review_id", 200, 7)


@query
def stratified_sample(spark, d):
    scores = texts.specificity_scores(rv(spark, d, "text"))
    first = sampling.simple_sample(rv(spark, d, "place_id"), "review_id", 200, 7)
    return sampling.stratified_sample(scores.join(first, "review_id", "left_anti"), "review_id", "band", {"HIGH": 30, "MEDIUM": 40, "LOW": 20}, 11)


@query
def largest_remainder(spark, d):
    sizes = rv(spark, d, "place_id").where("place_id IS NOT NULL").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    return sampling.allocate(sizes, "place_id", "n", 1000)


@query
def proportional_sample(spark, d):
    return sampling.proportional_sample(rv(spark, d, "place_id"), "review_id", "place_id", 500, 3)


@query
def cumulative_pick(spark, d):
    sizes = rv(spark, d, "place_id").where("place_id IS NOT NULL").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    reviews = sizes.agg(F.sum("n")).first()[0] or 0
    return sampling.pick_until(sizes, "place_id", "n", -(-reviews // 3))  # the places that hold a third of all reviews


@query
def place_band(spark, d):
    sizes = rv(spark, d, "place_id").where("place_id IS NOT NULL").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n").between(80, 150)).orderBy(F.desc("n"), "place_id").limit(250)


@query
def dataset_fingerprint(spark, d):
    r = rv(spark, d, "place_id", "text")
    word = lambda c: F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, -10).cast("long")
    digest = word(F.concat(F.col("review_id"), F.lit("\x00"), F.lower(strip(F.coalesce("text", F.lit(""))))))
    per = r.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("x"))
    all_ = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("p"), F.bit_xor("x").alias("x"), F.bit_xor(word(F.concat_ws(":", F.coalesce("place_id", F.lit("None")), "n"))).alias("y"))
    hex_ = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return all_.select(F.concat_ws("|", F.lit("v1"), "n", "p", hex_(F.col("x")), hex_(F.col("y")), F.lit("")).alias("fingerprint"))


@query
def pseudonyms(spark, d):
    salted = F.concat_ws("\x1f", F.lit("salt"), "reviewer_id")
    people = rv(spark, d, "reviewer_id").where("reviewer_id IS NOT NULL").select("reviewer_id").distinct()
    return people.select("reviewer_id", F.concat(F.lit("rv_"), F.substring(F.sha2(salted, 256), 1, 12)).alias("pseudonym"), F.substring(F.sha1("reviewer_id"), 1, 8).alias("short_id"))


@query
def cache_misses(spark, d):
    return vectors.cache_misses(rv(spark, d, "text"), table(spark, d, "embeddings_cache"), "minilm-multi-384")


@query
def cache_summary(spark, d):
    return vectors.cache_summary(table(spark, d, "embeddings_cache"))


@query
def mean_cosine(spark, d):
    cache = table(spark, d, "embeddings_cache").where("model_name = 'minilm-multi-384'")
    one = cache.where(F.size("embedding") == 384).groupBy("review_id").agg(F.min("embedding").alias("embedding"))
    return vectors.mean_cosine(one.join(rv(spark, d, "place_id").select("review_id", "place_id"), "review_id"), "place_id", "embedding", 384)


@query
def escaped_texts(spark, d):
    # The characters that Markdown gives a meaning.
    marked = F.regexp_replace("text", r"([\\`*_{}\[\]()#+\-.!|<>~])", r"\\$1")
    return rv(spark, d, "text").where("text IS NOT NULL").select("review_id", F.replace(marked, F.lit("\n"), F.lit("  \n")).alias("escaped"))


@query
def event_type_daily(spark, d):
    e = table(spark, d, "events").where("ts IS NOT NULL")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


ORACLES = composite_sql.ORACLES
