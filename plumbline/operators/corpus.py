"""Preparing raw corpora: categories, addresses, derived ids, skip counters, density checks and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.num import rnd

# How an address ends in a state and a postal code, and the words of a street line.
_STATE_ZIP = r"(?:^|,\s*)([A-Z]{2})\s+(\d{5})(?:-\d{4})?\s*$"
_STREET = (
    r"(?i)\b(st|street|ave|avenue|rd|road|hwy|highway|ln|lane|dr|drive|blvd|boulevard|ct|court|cir|circle|way|pl|place|pkwy|parkway|ter|terrace|sq|square|plz|plaza|trl|trail|rt|route|box|unit|ste|#)\b"
)


def single_category(rubrics: Column, rules: dict[str, tuple[list[str], list[str]]]) -> Column:
    """The one category of ``rules`` (name: words wanted, words excluded) that fits a list of rubrics separated by
    semicolons: some rubric holds a wanted word and none an excluded one. Null where none or several fit."""
    tokens = F.filter(F.transform(F.split(F.lower(F.coalesce(rubrics, F.lit(""))), ";"), lambda t: F.trim(t)), lambda t: t != "")
    holds = lambda words: F.exists(tokens, lambda t: F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)), True)) if words else F.lit(False)
    hits = F.array_compact(F.array(*[F.when(holds(wanted) & ~holds(excluded), F.lit(name)) for name, (wanted, excluded) in rules.items()]))
    return F.when(F.size(hits) == 1, F.element_at(hits, 1))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def city_and_region(address: Column) -> tuple[Column, Column]:
    """(city, region) of ``street, city, ST 12345``; both null unless the address ends in state and code, the city also
    where it starts with a digit or reads like a street. Full-width forms must be normalised before."""
    t = F.trim(address)
    region = F.nullif(F.regexp_extract(t, _STATE_ZIP, 1), F.lit(""))
    head = F.trim(F.rtrim(F.regexp_replace(F.rtrim(F.regexp_replace(t, _STATE_ZIP, "")), ",+$", "")))
    city = F.trim(F.substring_index(head, ",", -1))
    bad = (city == "") | city.rlike(r"^\d") | city.rlike(_STREET)
    return F.when(region.isNotNull() & ~bad, city), region


def iso_of_millis(ms: Column) -> Column:
    """Unix milliseconds as UTC with six digits and a written offset (the session zone must be UTC)."""
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def derived_id(prefix: str, length: int, *parts: Column) -> Column:
    """A short id from the given parts, the same in every run; null parts count as empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length))


def skip_counters(raw: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(reason, rows): rows by the first check that they fail, in the given order; rows that pass count as ``kept``."""
    reason = F.lit("kept")
    for name, failed in reversed(checks.items()):
        reason = F.when(F.coalesce(failed, F.lit(True)), F.lit(name)).otherwise(reason)
    return raw.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def density_violations(rv: DataFrame, place_reviews: int = 10, reviewer_reviews: int = 3, reviewer_places: int = 2) -> DataFrame:
    """(check, id, n): places and reviewers below the floors of a dense graph."""
    p = rv.where("place_id IS NOT NULL").groupBy("place_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < place_reviews)
    r = rv.where("reviewer_id IS NOT NULL").groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place_id").alias("k"))
    row = lambda df, check, key, n: df.select(F.lit(check).alias("check"), F.col(key).alias("id"), F.col(n).alias("n"))
    return (
        row(p, "place_reviews", "place_id", "n")
        .union(row(r.where(F.col("n") < reviewer_reviews), "reviewer_reviews", "reviewer_id", "n"))
        .union(row(r.where(F.col("k") < reviewer_places), "reviewer_places", "reviewer_id", "k"))
    )


def describe(values: DataFrame, column: str) -> DataFrame:
    """One row: count, least, quartiles, 90 % and most, interpolated."""
    q = F.percentile(column, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)]))
    x = values.agg(F.count(column).alias("n"), F.min(column).cast("double").alias("min"), q.alias("q"), F.max(column).cast("double").alias("max"))
    return x.select("n", "min", *[rnd(F.col("q")[i], 3).alias(name) for i, name in enumerate(("p25", "median", "p75", "p90"))], "max")


def corpus_stats(rv: DataFrame) -> DataFrame:
    """One row: rows, places, reviewers, links of places and reviewers, their density, and filled columns."""
    links = rv.where("place_id IS NOT NULL AND reviewer_id IS NOT NULL").groupBy("place_id", "reviewer_id").agg(F.count(F.lit(1)).alias("n"))
    graph = links.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("n") > 1).alias("repeated_links"))
    filled = lambda c: F.count_if(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    x = rv.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("place_id").alias("places"), F.countDistinct("reviewer_id").alias("reviewers"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("located"), filled("place_category").alias("categorised"), filled("text").alias("texts"),
    )
    return x.crossJoin(graph).withColumn("density", rnd(F.col("links") / F.nullif(F.col("places") * F.col("reviewers"), F.lit(0)), 6))  # one row by one row


def top_values(rv: DataFrame, column: str, top: int = 15) -> DataFrame:
    """The commonest values of a column; ties: the smaller value."""
    return rv.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def metadata_conflicts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, versions) of keys whose metadata is written in several ways; nulls are a value."""
    spelt = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in columns]))
    return rows.groupBy(key).agg(F.countDistinct(spelt).alias("versions")).where("versions > 1")


def record_fingerprint(columns: list[str]) -> Column:
    """sha256 over the columns in order of their names; null differs from the empty text."""
    parts = [F.coalesce(F.concat(F.lit(f"{c}="), F.col(c).cast("string")), F.lit(c)) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def human_duration(days: Column) -> Column:
    """A day count in words, ``no data`` where null or not positive."""
    years = F.regexp_replace(F.format_string("~%.1f years", days / 365), r"\.0 years", " years")
    months = F.concat(F.lit("~"), F.floor(days / 30).cast("string"), F.lit(" months"))
    return (
        F.when(days.isNull() | (days <= 0), "no data").when(days == 1, "1 day").when(days < 30, F.concat(F.lit("~"), days.cast("string"), F.lit(" days"))).when(days < 365, months).otherwise(years)
    )


def percent(fraction: Column, digits: int = 1) -> Column:
    return F.when(fraction.isNotNull(), F.format_string(f"%.{digits}f%%", rnd(fraction * 100, digits)))


def rating_mix(counts: list[Column]) -> Column:
    """Counts of one to five stars as text, most stars first, empty ones left out."""
    parts = [F.when(c > 0, F.concat(F.lit(f"{s}★×"), c.cast("string"))) for s, c in reversed(list(enumerate(counts, 1)))]
    return F.coalesce(F.nullif(F.concat_ws(" · ", *parts), F.lit("")), F.lit("no ratings on record"))


def burst_sentence(expected: Column, multiplier: Column) -> Column:
    """How a busy day compares with its baseline, in words; no ratio where the baseline is about zero."""
    return F.when(expected <= 0.05, "baseline below one review a day").otherwise(F.format_string("about %.1f times the baseline of ~%.1f reviews a day", multiplier, expected))
