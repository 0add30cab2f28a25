"""Queries of the dataset summary, the label reports, the families and the corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import corpus, families, graph, places, report, sampling, scoring, summary, temporal, validation, vectors
from plumbline.plans import composite, reports_sql
from plumbline.plans.reference import daily, rv
from plumbline.session import materialise, table

QUERIES = {}
#: name: (words wanted, words excluded)
CATEGORY_RULES = {"food": (["cafe", "coffee", "restaurant", "bakery", "bar"], ["barber"]), "care": (["clinic", "dent", "barber", "salon"], ["pet"]), "stay": (["hotel", "hostel", "inn"], ["dinner"])}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _summary(spark, d):
    r, templated, fam, clusters, signals = composite._scored(spark, d, *places.PLACE_KEYS, "reviewer_id", "published_at")
    evidence = materialise(scoring.review_evidence(r, templated, fam, clusters, signals), "evidence")
    # each as a table: in one plan they need more memory than the driver has
    weighted = materialise(scoring.weighted_rating(scoring.review_weights(r, evidence, composite.AS_OF)), "weighted")
    coordinated = materialise(scoring.coordinated_places(r, templated, fam, clusters, signals=signals), "coordinated")
    return materialise(summary.place_summary(r, places.place_meta(r), weighted, fam, templated, coordinated, clusters), "summary")


@query
def place_summary(spark, d):
    return _summary(spark, d)


@query
def category_rollup(spark, d):
    return summary.category_rollup(_summary(spark, d))


@query
def ranking_sections(spark, d):
    return summary.ranking_sections(_summary(spark, d))


def _families(spark, d):
    edges = composite._edges(spark, d)
    components = materialise(graph.connected_components(edges, "u", "v"), "components")
    return edges, components, materialise(graph.families(edges, components), "families")


@query
def place_listing(spark, d):
    r = materialise(rv(spark, d), "reviews")
    fam = _families(spark, d)[2]
    own = r.select("review_id", "place_id").join(fam.select("review_id", "family"), "review_id").groupBy("place_id", "family").agg(F.count(F.lit(1)).alias("k"))
    repeated = own.where("k >= 3").groupBy("place_id").agg(F.sum("k").alias("repeated"))
    sizes = r.where("place_id IS NOT NULL").groupBy("place_id").agg(F.count(F.lit(1)).alias("review_count"))
    rate = F.floor(1e6 * F.coalesce("repeated", F.lit(0)) / F.col("review_count") + 0.5) / 1e4
    rows = sizes.join(repeated, "place_id", "left").join(places.place_meta(r).select("place_id", "place_name", "place_category"), "place_id").select("*", rate.alias("duplicate_rate"))
    return summary.place_listing(rows, None, 10, "an", (0.0, 50.0)).select("place_id", "place_name", "place_category", "review_count", "duplicate_rate")


@query
def family_context(spark, d):
    return summary.family_context(rv(spark, d, "rating", "day"), _families(spark, d)[2])


@query
def family_filter(spark, d):
    edges, components, fam = _families(spark, d)
    context = summary.family_context(rv(spark, d, "rating", "day"), fam)
    kept = summary.family_filter(graph.family_structure(edges, components), context, 3, ["near", "fuzzy"], 0.8, 0.2)
    return kept.select("component", "members", "links", "avg_similarity", "concentration")


@query
def member_links(spark, d):
    """Links with the labels of both ends."""
    labels = validation.clean_labels(table(spark, d, "human_labels")).groupBy("review_id").agg(F.min("duplicate_label").alias("label"))
    side = lambda n: labels.select(F.col("review_id").alias(n), F.col("label").alias("label_" + n))
    return graph.best_links(composite._edges(spark, d)).join(side("u"), "u", "left").join(side("v"), "v", "left").select("u", "v", "kind", "score", "label_u", "label_v").where("label_u IS NOT NULL OR label_v IS NOT NULL")


@query
def duplicate_families(spark, d):
    return families.duplicate_families(rv(spark, d, "place_id", "text"))[1]


@query
def duplicate_members(spark, d):
    return families.duplicate_families(rv(spark, d, "place_id", "text"))[0]


@query
def text_links(spark, d):
    """Similar texts of a place; classes of equal texts stand for their copies."""
    links = families.text_links(materialise(families.text_classes(rv(spark, d, "place_id", "text")), "classes"))
    return links.select("place_id", "a", "b", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


def _labels(spark, d):
    return validation.clean_labels(table(spark, d, "human_labels"))


def _selection(spark, d):
    """Half of the reviews as a selection of either type, by their id."""
    kind = F.when(F.col("review_id") < "rv8", "evaluation").otherwise("challenge")
    return rv(spark, d, "place_id").select("review_id", kind.alias("sample_type"))


def _judged(spark, d):
    r, templated, fam, _, _ = composite._scored(spark, d)
    scores = templated.select("review_id", "templated").join(r.select("review_id", F.col("spec").alias("specificity"), "text"), "review_id")
    sized = fam.select("review_id", "family_size")
    return report.with_sample_type(_labels(spark, d), _selection(spark, d)).join(scores, "review_id").join(sized, "review_id", "left")


@query
def label_partitions(spark, d):
    return report.partition_metrics(_judged(spark, d))


@query
def disagreement_rows(spark, d):
    return report.disagreements(_judged(spark, d))


@query
def unmatched_labels(spark, d):
    return report.unmatched(_labels(spark, d), rv(spark, d, "place_id"))


@query
def annotation_queue(spark, d):
    return report.unlabelled(rv(spark, d, "place_id"), _labels(spark, d))


@query
def annotation_progress(spark, d):
    return report.progress(_labels(spark, d))


@query
def label_ids_equal(spark, d):
    return report.same_ids(_labels(spark, d), rv(spark, d, "place_id"))


@query
def group_agreement(spark, d):
    human = _labels(spark, d).where("duplicate_label = 'duplicate'").select("review_id", F.col("duplicate_group_id").alias("group"))
    found = _families(spark, d)[2].select("review_id", F.col("family").alias("group"))
    return report.group_agreement(human, found)


@query
def challenge_strata(spark, d):
    """Samples of disjoint strata in their order: high, medium, low and duplicate, without the evaluation sample."""
    r = composite._reviews(spark, d, "place_id", "text", "day")
    levels = scoring.templated_scores(r).select("review_id", F.when(F.col("templated") >= 65, "high").when(F.col("templated") >= 40, "medium").otherwise("low").alias("stratum"))
    first = sampling.simple_sample(r, "review_id", 200, 7)
    three = materialise(sampling.stratified_sample(levels.join(first, "review_id", "left_anti"), "review_id", "stratum", {"high": 30, "medium": 40, "low": 20}, 11), "sample")
    pool = _families(spark, d)[2].select("review_id").distinct().join(first, "review_id", "left_anti").join(three, "review_id", "left_anti")
    return three.union(sampling.simple_sample(pool, "review_id", 25, 13).withColumn("stratum", F.lit("duplicate")))


@query
def place_reviewers(spark, d):
    return rv(spark, d, "place_id", "reviewer_id").where("place_id IS NOT NULL AND reviewer_id IS NOT NULL").select("place_id", "reviewer_id").distinct()


@query
def ranked_events(spark, d):
    """Bursts in the order of their severity, then day and place."""
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    e = temporal.burst_events(daily(spark, d))
    said = corpus.burst_sentence(F.col("expected"), F.col("multiplier"))
    return e.select("place_id", "day", "severity", rank.alias("severity_rank"), said.alias("sentence"), corpus.rating_mix([F.col(f"r{s}") for s in range(1, 6)]).alias("mix")).orderBy("severity_rank", "day", "place_id")


@query
def single_categories(spark, d):
    c = rv(spark, d, "place_category").where("place_category IS NOT NULL").select("place_category").distinct()
    return c.select("place_category", corpus.single_category(F.col("place_category"), CATEGORY_RULES).alias("category"))


@query
def skip_counters(spark, d):
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    return corpus.skip_counters(table(spark, d, "reviews"), {"rating": F.col("rating").isNull(), "text": blank("text"), "place": blank("place_name")})


@query
def first_locations(spark, d):
    return rv(spark, d, "city", "region", "country").select("review_id", corpus.first_filled(F.col("city"), F.col("region"), F.col("country")).alias("location"))


@query
def iso_millis(spark, d):
    e = table(spark, d, "events").where("ts IS NOT NULL")
    return e.select("event_id", corpus.iso_of_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("iso"))


@query
def derived_ids(spark, d):
    r = rv(spark, d, "place_id", "reviewer_id", "place_name", "city")
    return r.select("review_id", corpus.derived_id("pl_", 10, F.col("place_name"), F.col("city")).alias("place_key"), corpus.derived_id("rw_", 16, F.col("reviewer_id"), F.col("place_id"), F.col("review_id")).alias("review_key"))


@query
def record_fingerprints(spark, d):
    columns = ["place_id", "reviewer_id", "rating", "text", "city"]
    return rv(spark, d, *columns).select("review_id", corpus.record_fingerprint(columns).alias("fingerprint"))


@query
def density_violations(spark, d):
    return corpus.density_violations(rv(spark, d, "place_id", "reviewer_id"))


@query
def reviews_per_place(spark, d):
    sizes = rv(spark, d, "place_id").where("place_id IS NOT NULL").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    return corpus.describe(sizes, "n")


@query
def corpus_stats(spark, d):
    return corpus.corpus_stats(rv(spark, d, "place_id", "reviewer_id", "latitude", "longitude", "place_category", "text"))


@query
def top_categories(spark, d):
    return corpus.top_values(rv(spark, d, "place_category"), "place_category")


@query
def metadata_conflicts(spark, d):
    return corpus.metadata_conflicts(rv(spark, d, "place_id", "place_name", "city", "region", "country"), "place_id", ["place_name", "city", "region", "country"])


@query
def reviewer_periods(spark, d):
    """Active period in words, and the share of five stars as a percentage."""
    per = rv(spark, d, "reviewer_id", "rating", "day").groupBy("reviewer_id").agg(
        F.when(F.count("day") == 1, 1).when(F.count("day") > 1, F.greatest(F.lit(1), F.datediff(F.max("day"), F.min("day")))).alias("days"), F.avg((F.col("rating") == 5).cast("int")).alias("share")
    )
    return per.select("reviewer_id", corpus.human_duration(F.col("days")).alias("period"), corpus.percent(F.col("share")).alias("five_star"))


@query
def centre_cosines(spark, d):
    cache = table(spark, d, "embeddings_cache").where("model_name = 'minilm-multi-384'")
    one = cache.where(F.size("embedding") == 384).groupBy("review_id").agg(F.min("embedding").alias("embedding"))
    return vectors.centre_cosines(one.join(rv(spark, d, "place_id"), "review_id"), "place_id", "review_id", "embedding", 384)


ORACLES = reports_sql.ORACLES
