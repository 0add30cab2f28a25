"""Scores of single texts and of texts among the others of their place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from plumbline.config import CONFIG, SpecificityConfig, TemplatedConfig
from plumbline.functions import lexicon
from plumbline.functions.num import band, clamp, rnd
from plumbline.functions.text import WORD, squeeze

CYRILLIC_LATIN = "[а-яёa-z]+"


def _any(text: Column, phrases: list[str]) -> Column:
    return text.rlike("|".join(phrases))


def specificity(text: Column, cfg: SpecificityConfig = CONFIG.specificity) -> Column:
    """0 to 100: how concrete a text is; 0 for null and blank texts."""
    return _specificity(F.lower(F.coalesce(text, F.lit(""))), cfg, _any)


def _specificity(t: Column, cfg: SpecificityConfig, has: Callable[[Column, list[str]], Column]) -> Column:
    add = lambda cond, points: F.when(cond, F.lit(points)).otherwise(0.0)
    score = (
        F.lit(cfg.base)
        + add(t.rlike(r"\p{Nd}"), cfg.numbers)
        + add(F.regexp_count(t, F.lit(f"[{WORD}]{{6,}}")) >= 5, cfg.entities)
        + add(t.rlike(f"(?<![{WORD}])({'|'.join(lexicon.WAIT)})(?![{WORD}])"), cfg.wait)
        + add(has(t, lexicon.PRODUCTS), cfg.product)
        + add(has(t, lexicon.STAFF), cfg.staff)
        + add(has(t, lexicon.NARRATIVE), cfg.narrative)
        + add(F.length(t) > 200, cfg.long_text)
    )
    score = F.when(F.length(t) < 50, score * cfg.short_factor).otherwise(score)
    # one generic phrase already exceeds the cap, so the penalty does not depend on their number
    score = score - add(has(t, lexicon.GENERIC), min(cfg.generic, cfg.generic_cap))
    return F.when(F.trim(squeeze(t)) == "", 0.0).otherwise(rnd(clamp(score, 0.0, 100.0), 1))


def with_specificity(rv: DataFrame) -> DataFrame:
    """``rv`` with the specificity of its texts as ``spec``, unless it has that column already."""
    return rv if "spec" in rv.columns else rv.withColumn("spec", specificity(F.col("text")))


def specificity_table(rv: DataFrame) -> DataFrame:
    """``rv`` with ``spec`` as ``with_specificity`` has it, for whole tables: the word lists are sought in Arrow batches by
    automata, in one pass over a text, which takes a fraction of the time of Java's alternatives."""
    lists = [lexicon.PRODUCTS, lexicon.STAFF, lexicon.NARRATIVE, lexicon.GENERIC]
    named = [f"__has{i}" for i in range(len(lists))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pc.match_substring_regex(b.column("__low"), "|".join(p)) for p in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, *named])

    low = rv.withColumn("__low", F.lower(F.coalesce(F.col("text"), F.lit(""))))
    schema = StructType([*low.schema.fields, *[StructField(n, BooleanType()) for n in named]])
    score = _specificity(F.col("__low"), CONFIG.specificity, lambda t, p: F.col(named[lists.index(p)]))
    return low.mapInArrow(run, schema).withColumn("spec", score).drop("__low", *named)


def specificity_scores(rv: DataFrame) -> DataFrame:
    return rv.select("review_id", specificity(F.col("text")).alias("specificity")).withColumn("band", band(F.col("specificity"), 40, 65))


def content_tokens(text: Column, least: int = 1) -> Column:
    """Lower-case words of Cyrillic and Latin letters without stop words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CYRILLIC_LATIN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(lexicon.STOP) & (F.length(w) >= least))


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent n-grams joined by a blank, in order and with repeats.

    Zips the tokens with themselves shifted, so no lambda reads the whole array for every position.
    """
    out = tokens
    for k in range(1, n):
        left = F.greatest(F.size(tokens) - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), left), F.slice(tokens, F.lit(k + 1), left), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?…]+"), lambda s: squeeze(s)), lambda s: s != "")


def words_in(sentence: Column) -> Column:
    return F.size(F.split(sentence, " "))


def sentence_profiles(rv: DataFrame) -> DataFrame:
    """(place_id, review_id, profile): shares of sentences with 0-7, 8-15, ... words in six bins; null
    without sentences."""
    bins = F.transform(sentences(F.col("text")), lambda s: F.least(F.floor(words_in(s) / 8).cast("int"), F.lit(5)))
    cut = rv.select("place_id", "review_id", bins.alias("bins"))
    n = F.size("bins")
    share = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda b: rnd(F.size(F.filter("bins", lambda x: x == b)) / n, 6))
    return cut.select("place_id", "review_id", F.when(n > 0, share).alias("profile"))


def style_uniformity(rv: DataFrame) -> DataFrame:
    """Per place 1 - scaled variation of sentence lengths; 0 below two sentences."""
    lengths = rv.select("place_id", F.explode(F.transform(sentences(F.col("text")), lambda s: words_in(s))).alias("n"))
    cv = F.stddev_pop("n") / (F.avg("n") + 1e-9)
    return lengths.groupBy("place_id").agg(F.count(F.lit(1)).alias("sentences"), rnd(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(1 - clamp((cv - 0.25) / 0.65, 0.0, 1.0)), 4).alias("uniformity"))


def _owners(long: DataFrame, term: str) -> DataFrame:
    return long.select("place_id", term, "review_id").distinct().groupBy("place_id", term).agg(F.count(F.lit(1)).alias("owners"))


def phrase_reuse(rv: DataFrame, cfg: TemplatedConfig = CONFIG.templated) -> DataFrame:
    """Per review: share of its content tokens inside 2- and 3-grams that at least ``owners`` other reviews
    of the place contain. Owners are counted in one shuffle by (place, n-gram), where a phrase that a third
    of all reviews share is pre-aggregated."""
    t = rv.select("place_id", "review_id", content_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)

    def placed(k: int) -> Column:
        return F.transform(ngrams(F.col("t"), k), lambda g, i: F.struct(g.alias("g"), i.alias("at"), F.lit(k).alias("k")))

    grams = t.select("place_id", "review_id", F.size("t").alias("n"), "t").select(
        "place_id", "review_id", "n",
        F.explode(F.concat(placed(2), placed(3))).alias("x"),
    ).select("place_id", "review_id", "n", "x.*")
    hot = _owners(grams, "g").where(F.col("owners") - 1 >= cfg.owners)
    spots = grams.join(hot, ["place_id", "g"]).select("place_id", "review_id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1)).alias("p"))
    covered = spots.groupBy("place_id", "review_id").agg(F.countDistinct("p").alias("covered"))
    sized = t.select("place_id", "review_id", F.size("t").alias("tokens"))
    cov = F.coalesce("covered", F.lit(0)) / F.col("tokens")
    return sized.join(covered, ["place_id", "review_id"], "left").select(
        "review_id", "tokens", rnd(cov, 4).alias("coverage"), rnd(clamp((cov - 0.5) / 0.25, 0.0, 1.0), 4).alias("phrase_reuse")
    )


def unique_detail(rv: DataFrame, cfg: TemplatedConfig = CONFIG.templated) -> DataFrame:
    """Per review: share of distinct content words that at most ``rare`` other reviews of the place use."""
    words = rv.select("place_id", "review_id", F.explode(F.array_distinct(content_tokens(F.col("text")))).alias("w"))
    rare = (F.col("owners") - 1 <= cfg.rare).cast("int")
    joined = words.join(_owners(words, "w"), ["place_id", "w"])
    out = joined.groupBy("review_id").agg(F.count(F.lit(1)).alias("words"), F.sum(rare).alias("rare"))
    return out.select("review_id", "words", "rare", rnd(clamp((1 - F.col("rare") / F.col("words")) / 0.5, 0.0, 1.0), 4).alias("low_unique_detail"))


def structure_similarity(rv: DataFrame, top: int = 5) -> DataFrame:
    """Per place and sentence profile: mean of the ``top`` largest cosines with the profiles of the other
    reviews. Few distinct profiles exist, so they are compared instead of the reviews, with their counts."""
    zero = F.array(*[F.lit(0.0)] * 6)
    prof = sentence_profiles(rv).select("place_id", "review_id", F.coalesce("profile", zero).alias("f"))
    counts = prof.groupBy("place_id", "f").agg(F.count(F.lit(1)).alias("n"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    dot = F.aggregate(F.zip_with("f", "g", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = counts.select("place_id", "f").join(counts.select("place_id", F.col("f").alias("g"), F.col("n").alias("m")), "place_id")
    sims = pairs.withColumn("sim", dot / (norm(F.col("f")) * norm(F.col("g")))).withColumn("m", F.when(F.col("f") == F.col("g"), F.col("m") - 1).otherwise(F.col("m")))
    best = F.slice(F.sort_array(F.collect_list(F.struct("sim", "m")), asc=False), 1, top + 1)
    taken = F.aggregate(
        "best", F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("k")),
        lambda a, x: F.struct((a["s"] + x["sim"] * F.least(x["m"], F.lit(top) - a["k"])).alias("s"), (a["k"] + F.least(x["m"], F.lit(top) - a["k"])).alias("k")),
    )
    per = sims.where("m > 0").groupBy("place_id", "f").agg(best.alias("best")).select("place_id", "f", taken.alias("a")).select("place_id", "f", (F.col("a.s") / F.col("a.k")).alias("mean"))
    return prof.join(per, ["place_id", "f"], "left").select("review_id", rnd(F.coalesce(clamp((F.col("mean") - 0.6) / 0.35, 0.0, 1.0), F.lit(0.0)), 4).alias("structure"))


def exact_groups(rv: DataFrame) -> DataFrame:
    """Texts of a place that are equal after normalisation; null and blank texts are equal to each other."""
    key = F.sha2(F.coalesce(squeeze(F.col("text")), F.lit("")), 256)
    return (
        rv.groupBy("place_id", key.alias("text_hash"))
        .agg(F.count(F.lit(1)).alias("members"), F.min("review_id").alias("first_review"))
        .where("members > 1")
    )


def set_links(prefix: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(place_id, h, k): for each of ``sets`` (place_id, h, s, m) how many copies ``m`` the other sets of its place with a
    Jaccard similarity of at least ``t`` have; sets without any are left out. ``prefix``: (place_id, h, n, g), the
    elements g by which each set, of n elements, is found."""
    other = prefix.select("place_id", "g", F.col("h").alias("h2"), F.col("n").alias("n2"))
    cand = prefix.join(other, ["place_id", "g"]).where((F.col("h") < F.col("h2")) & (F.least("n", "n2") >= F.greatest("n", "n2") * t)).select("place_id", "h", "h2").distinct()
    full = sets.select("place_id", "h", "s", "m")
    pairs = cand.join(full, ["place_id", "h"]).join(full.select("place_id", F.col("h").alias("h2"), F.col("s").alias("s2"), F.col("m").alias("m2")), ["place_id", "h2"])
    both = F.size(F.array_intersect("s", "s2"))
    pairs = pairs.where(both >= t * (F.size("s") + F.size("s2") - both))
    links = pairs.select("place_id", "h", F.col("m2").alias("k")).union(pairs.select("place_id", F.col("h2").alias("h"), F.col("m").alias("k")))
    return links.groupBy("place_id", "h").agg(F.sum("k").alias("k"))


def bigram_peers(rv: DataFrame, cfg: TemplatedConfig = CONFIG.templated) -> DataFrame:
    """Per review: other reviews of its place whose sets of content bigrams have a Jaccard similarity of at
    least ``peer_similarity`` (the fallback without vectors).

    Exact by prefix filtering: sets are ordered by how common their bigrams are in the place, and similar sets
    share one of the first ceil((1 - t) n) + 1. Equal sets are one set with a count, so a text copied many
    times is compared once.
    """
    t = cfg.peer_similarity
    words = rv.select("place_id", "review_id", content_tokens(F.col("text")).alias("t"))
    base = words.select("place_id", "review_id", F.array_sort(F.array_distinct(ngrams(F.col("t"), 2))).alias("s"))
    sets = base.groupBy("place_id", "s").agg(F.count(F.lit(1)).alias("m")).where(F.size("s") > 0).withColumn("h", F.xxhash64("s"))
    grams = sets.select("place_id", "h", F.size("s").alias("n"), F.explode("s").alias("g"))
    common = grams.groupBy("place_id", "g").agg(F.count(F.lit(1)).alias("c"))
    ordered = grams.join(common, ["place_id", "g"]).groupBy("place_id", "h", "n").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("o"))
    prefix = ordered.select(
        "place_id", "h", "n", F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * t) + 1).cast("int"))).alias("x")
    ).select("place_id", "h", "n", F.col("x.g").alias("g"))
    near = set_links(prefix, sets, t)
    per = sets.join(near, ["place_id", "h"], "left").select("place_id", "s", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("peers"))
    return base.join(per, ["place_id", "s"], "left").select("review_id", F.coalesce("peers", F.lit(0)).cast("long").alias("peers"))
