"""Daily series of all places at once: bursts, rating shifts and temporal signals.

Reviews are counted per place and day first, so every window below runs over the days of a place, a group
that the calendar bounds, never over its reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.config import CONFIG, BurstConfig, RatingShiftConfig
from plumbline.functions.num import band, clamp, jsd, rnd

STARS = (1, 2, 3, 4, 5)


def daily_counts(rv: DataFrame) -> DataFrame:
    """(place_id, day, n, r1..r5) of dated reviews."""
    return (
        rv.where("place_id IS NOT NULL AND day IS NOT NULL")
        .groupBy("place_id", "day")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rating") == s).alias(f"r{s}") for s in STARS])
    )


def fill_calendar(daily: DataFrame) -> DataFrame:
    """Every day of each place from its first to its last, with 0 where nothing happened."""
    span = daily.groupBy("place_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("place_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return days.join(daily, ["place_id", "day"], "left").na.fill(0)


def _middle(a: Column) -> Column:
    """Median of an array with an even number of values."""
    s = F.sort_array(a)
    n = F.size(a)
    return (F.get(s, (n / 2 - 1).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2.0


def burst_events(daily: DataFrame, cfg: BurstConfig = CONFIG.burst) -> DataFrame:
    """Days whose volume stands out from the median and MAD of the ``window`` calendar days before.

    The first ``window`` days of a place have no baseline. Only MEDIUM and HIGH days are returned.
    Only days with ``min_reviews`` look back, by an equi-join on the days before them; days without
    reviews are added as zeros, so no calendar is built.
    """
    first = daily.groupBy("place_id").agg(F.min("day").alias("first"))
    busy = daily.where(F.col("n") >= cfg.min_reviews).join(first, "place_id").where(F.datediff("day", "first") >= cfg.window)
    before = busy.select("place_id", F.col("day").alias("event"), F.explode(F.sequence(F.lit(1), F.lit(cfg.window))).alias("o"))
    before = before.withColumn("day", F.date_sub("event", F.col("o"))).join(daily.select("place_id", "day", "n"), ["place_id", "day"])
    seen = before.groupBy("place_id", F.col("event").alias("day")).agg(F.collect_list("n").alias("b"))  # at most one per day
    base = busy.join(seen, ["place_id", "day"], "left").withColumn("b", F.coalesce("b", F.array().cast("array<bigint>")))
    base = base.withColumn("b", F.concat("b", F.array_repeat(F.lit(0).cast("long"), F.lit(cfg.window) - F.size("b"))))
    seen = base.withColumn("med", _middle(F.col("b")))
    # the median goes in as an array: a lambda would compute it again for every element
    away = F.zip_with("b", F.array_repeat("med", cfg.window), lambda x, m: F.abs(x - m))
    seen = seen.withColumn("mad", _middle(away))
    z = F.lit(0.6745) * (F.col("n") - F.col("med")) / F.greatest(F.col("mad"), F.lit(1.0))
    scored = seen.withColumn("z", z).withColumn("mult", F.col("n") / F.greatest(F.col("med"), F.lit(1.0)))
    severity = (
        F.when(F.col("z") >= cfg.z * 1.5, "HIGH")
        .when(F.col("z") >= cfg.z, "MEDIUM")
        .when((F.col("med") >= 1) & (F.col("mult") >= cfg.multiplier), "MEDIUM")
    )
    score = clamp((F.col("z") - cfg.z * 0.5) / (cfg.z * 1.5), 0.0, 1.0) * 100
    return scored.withColumn("severity", severity).where("severity IS NOT NULL").select(
        "place_id",
        "day",
        F.col("n").alias("observed"),
        rnd(F.col("med"), 2).alias("expected"),
        rnd(F.col("mult"), 2).alias("multiplier"),
        rnd(F.col("z"), 2).alias("z_score"),
        rnd(F.col("mad"), 2).alias("mad"),
        rnd(score, 1).alias("score"),
        "severity",
        *[f"r{s}" for s in STARS],
    )


def rating_shifts(daily: DataFrame, events: DataFrame, cfg: RatingShiftConfig = CONFIG.shift) -> DataFrame:
    """Rating distribution around each event against the ``baseline`` days before it.

    A range join of events and days that becomes an equi-join: every event lists the days of its two
    windows. LOW results are returned too, events without rated reviews in either window are not.
    """
    before, after = (cfg.window - 1) // 2, cfg.window // 2
    e = events.where(F.col("observed") >= cfg.min_reviews).select("place_id", F.col("day").alias("event_day"))
    offsets = F.sequence(F.lit(-cfg.baseline), F.lit(after))
    listed = e.withColumn("o", F.explode(offsets)).withColumn("day", F.date_add("event_day", F.col("o")))
    window = F.col("o") >= -before
    sums = (
        listed.join(daily, ["place_id", "day"])
        .groupBy("place_id", "event_day")
        .agg(*[F.sum(F.when(cond, F.col(f"r{s}")).otherwise(0)).alias(f"{side}{s}") for side, cond in (("b", ~window), ("e", window)) for s in STARS])
    )
    for side in "be":
        sums = sums.withColumn(side, sum((F.col(f"{side}{s}") for s in STARS), F.lit(0)))
    sums = sums.where("b > 0 AND e > 0")
    share = lambda side: [rnd(F.col(f"{side}{s}") / F.col(side), 4) for s in STARS]
    p, q = share("b"), share("e")
    out = sums.withColumn("jsd", rnd(jsd(p, q), 4)).withColumn("top_share", F.greatest(*q))

    def dominant(xs: list[Column]) -> Column:
        top, pick = F.greatest(*xs), F.lit(None).cast("int")
        for s, x in reversed(list(zip(STARS, xs, strict=True))):
            pick = F.when(x == top, s).otherwise(pick)
        return pick

    return out.select(
        "place_id",
        F.col("event_day").alias("day"),
        "jsd",
        F.col("top_share"),
        dominant(p).alias("baseline_rating"),
        dominant(q).alias("event_rating"),
        F.when((F.col("jsd") >= 2 * cfg.jsd) & (F.col("top_share") >= cfg.dominant), "HIGH").when(F.col("jsd") >= cfg.jsd, "MEDIUM").otherwise("LOW").alias("severity"),
        rnd(clamp(F.col("jsd") / (2 * cfg.jsd), 0.0, 1.0) * 100, 1).alias("score"),
    )


def gap_signal(daily: DataFrame) -> DataFrame:
    """Per place 1 - median gap / 7 between consecutive reviews, at least 0; 0 below two dated reviews.

    Reviews of one day are gaps of 0, so the gaps are weighted days.
    """
    w = Window.partitionBy("place_id").orderBy("day")
    gaps = daily.select("place_id", "n", F.datediff("day", F.lag("day").over(w)).alias("g"))
    weighted = gaps.select("place_id", F.explode(F.array(
        F.struct(F.lit(0).alias("g"), (F.col("n") - 1).alias("k")), F.struct(F.col("g").alias("g"), F.when(F.col("g").isNull(), 0).otherwise(1).cast("long").alias("k"))
    )).alias("x")).select("place_id", F.coalesce("x.g", F.lit(0)).alias("g"), "x.k")
    med = F.when(F.sum("k") > 0, F.expr("percentile(g, 0.5, k)"))
    out = weighted.groupBy("place_id").agg(med.alias("median_gap"))
    return out.select("place_id", "median_gap", rnd(F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("median_gap") / 7.0), F.lit(0.0)), 4).alias("temporal_density"))


def peer_counts(daily: DataFrame, reach: int = 7) -> DataFrame:
    """Per place and active day: other reviews within ``reach`` days on either side of a review of that day."""
    w = Window.partitionBy("place_id").orderBy(F.unix_date("day")).rangeBetween(-reach, reach)
    return daily.select("place_id", "day", "n", (F.sum("n").over(w) - 1).alias("peers"))


def event_days(events: DataFrame, shifts: DataFrame) -> DataFrame:
    """Distinct (place_id, day) of bursts and of rating shifts, the latter with the day on either side."""
    around = shifts.select("place_id", F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1))).alias("day"))
    return events.select("place_id", "day").union(around).distinct()


def _near_strengths(events: DataFrame, shifts: DataFrame, shift: Column) -> DataFrame:
    near = lambda df, v: df.select("place_id", F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1))).alias("day"), v)
    b = near(events, clamp(F.col("z_score") / 10, 0.0, 1.0).alias("v")).groupBy("place_id", "day").agg(F.max("v").alias("burst"))
    s = near(shifts, shift.alias("v")).groupBy("place_id", "day").agg(F.max("v").alias("shift"))
    return b.join(s, ["place_id", "day"], "full").select("place_id", "day", rnd(F.coalesce("burst", F.lit(0.0)), 4).alias("burst"), rnd(F.coalesce("shift", F.lit(0.0)), 4).alias("shift"))


def day_strengths(events: DataFrame, shifts: DataFrame) -> DataFrame:
    """(place_id, day, burst, shift): the largest z / 10 and jsd / 0.3 of events at most a day away, up to 1."""
    return _near_strengths(events, shifts, clamp(F.col("jsd") / 0.3, 0.0, 1.0))


def agreed_strengths(events: DataFrame, shifts: DataFrame) -> DataFrame:
    """``day_strengths`` whose shifts count by how much of their ratings are one star: in full from a share of
    0.7, by half from 0.5, by 0.15 from 0.3, else not at all."""
    share = F.col("top_share")
    agreement = F.when(share >= 0.7, 1.0).when(share >= 0.5, 0.5).when(share >= 0.3, 0.15).otherwise(0.0)
    return _near_strengths(events, shifts, clamp(F.col("jsd") / 0.3, 0.0, 1.0) * agreement)
