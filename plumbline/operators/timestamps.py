"""One unambiguous UTC instant for every written timestamp.

Written local times are matched as-of to the zone's offset intervals: exactly one interval gives the
offset, two make the time ambiguous, none makes it nonexistent; both latter cases take the offset in
force before the change.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import timeparse

#: Rules are read for these years; before and after, the offset at that end holds.
FIRST_YEAR, LAST_YEAR = 1840, 2100
#: Sources beyond this number are joined without a broadcast.
FEW_SOURCES = 10_000
_FAR = 4 * 10**17  # microseconds, beyond year 9999 on either side
UTC_FORM = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@lru_cache(maxsize=1024)
def offset_intervals(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(utc_from, utc_to, offset) in seconds, in order, found by probing and bisecting the rules."""
    z = zoneinfo.ZoneInfo(zone)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

    def offset(t: int) -> int:
        return int((epoch + dt.timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())

    start = int((dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.timezone.utc) - epoch).total_seconds())
    stop = int((dt.datetime(LAST_YEAR, 12, 31, tzinfo=dt.timezone.utc) - epoch).total_seconds())
    changes, t, now, step = [], start, offset(start), 86400  # no zone changes twice within a day
    while t < stop:
        after = offset(t + step)
        if after != now:
            lo, hi = t, t + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
            changes.append((hi, now))
            t, now = hi, offset(hi)
        else:
            t += step
    edges = [-(_FAR // 10**6), *(c for c, _ in changes), _FAR // 10**6]
    offsets = [*(o for _, o in changes), now]
    return tuple((edges[i], edges[i + 1], o) for i, o in enumerate(offsets))


_INTERVALS = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("zone_year", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("local_from", T.LongType()),
        T.StructField("local_to", T.LongType()),
        T.StructField("offset_s", T.IntegerType()),
    ]))),
])


def zone_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    """Offset intervals in local microseconds, exploded to one row per zone and year.

    Its size is bounded by the zone database: at most about 600 names x 261 years of a few intervals.
    """
    rows = []
    for zone in sorted(set(zones)):
        local = [((f + o) * 10**6, (t + o) * 10**6, o) for f, t, o in offset_intervals(zone)]
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            lo = int((dt.datetime(year, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds() - 3 * 86400) * 10**6
            hi = int((dt.datetime(year, 12, 31) - dt.datetime(1970, 1, 1)).total_seconds() + 4 * 86400) * 10**6
            lo, hi = (-_FAR if year == FIRST_YEAR else lo), (_FAR if year == LAST_YEAR else hi)
            rows.append((zone, year, [x for x in local if x[0] < hi and x[1] > lo]))
    return spark.createDataFrame(rows, _INTERVALS)


def _known(name: str) -> Column:
    return F.expr(f"{name} IN ({', '.join(repr(z) for z in sorted(zoneinfo.available_timezones()))})")


def written_zones(df: DataFrame, column: str = "published_at") -> list[str]:
    """The names of the zone database that occur in ``column``."""
    name = F.regexp_extract(F.col(column).cast("string"), r"([A-Za-z][A-Za-z_+-]*(?:/[A-Za-z0-9_+-]+)+)", 1)
    found = df.where(F.col(column).contains("/")).select(name.alias("z")).where(_known("z")).distinct()
    return [r[0] for r in found.collect()]  # names of the zone database only


def with_instants(
    df: DataFrame,
    sources: DataFrame | None = None,
    column: str = "published_at",
    source_column: str = "source",
    zones: list[str] | None = None,
) -> DataFrame:
    """Adds ``instant_us`` (long), ``utc_day`` (date) and ``zone_note`` to every row of ``df``.

    ``sources`` (source, naive_zone, date_order) tells how a source writes wall clocks; a source
    that is null or not listed counts as UTC with the day first, as do a null zone or order there.
    Null, empty, blank or unreadable values, unknown zone names and dates that do not exist get a
    null instant. ``zone_note`` is ``ambiguous`` or ``nonexistent`` for wall clocks inside a change,
    ``exact`` for other instants, else null. Rows are neither dropped nor repeated; columns of ``df``
    that bear one of the three added names are replaced, other columns stay as they are.
    ``zones``: the zone names that may be written, if known; else ``df`` is read once to find them. Years
    outside ``FIRST_YEAR``..``LAST_YEAR`` have the offset of that end. Needs no shuffle while there are at
    most ``FEW_SOURCES`` sources: the zone table is bounded by the zone database.
    """
    spark = df.sparkSession
    df = df.drop("instant_us", "utc_day", "zone_note")
    known = zoneinfo.available_timezones()
    t = "__ts_"
    src = F.col(source_column) if source_column in df.columns else F.lit(None).cast("string")
    work = df.withColumn(t + "src", src)
    naive: list[str] = []
    if sources is None:
        work = work.withColumn(t + "nz", F.lit("UTC")).withColumn(t + "mdy", F.lit(False))
    else:
        conf = sources.select(
            F.col("source").alias(t + "src"),
            F.coalesce("naive_zone", F.lit("UTC")).alias(t + "nz"),
            (F.coalesce("date_order", F.lit("dmy")) == "mdy").alias(t + "mdy"),
        ).dropDuplicates([t + "src"])
        first = conf.limit(FEW_SOURCES + 1).collect()
        few = len(first) <= FEW_SOURCES
        naive = [r[t + "nz"] for r in first] if few else [r[0] for r in conf.select(t + "nz").distinct().where(_known(t + "nz")).collect()]  # names of the zone database
        work = work.join(F.broadcast(conf) if few else conf, t + "src", "left").fillna({t + "nz": "UTC", t + "mdy": False})
    c = F.col(column).cast("string")
    tidied = work.withColumn(t + "c", timeparse.tidy(c))
    parts = tidied.withColumn(t + "p", timeparse.parse(F.col(t + "c"), F.col(t + "mdy")))
    parsed = timeparse.finish(parts, t + "p", t + "nz", t)
    written = written_zones(df, column) if zones is None else zones
    spans = zone_table(spark, [z for z in {*naive, *written} if z in known]).select(
        F.col("zone").alias(t + "z"), F.col("zone_year").alias(t + "y"), F.col("spans").alias(t + "s")
    )
    year = F.year(F.timestamp_micros(t + "us"))
    keyed = parsed.withColumn(t + "z", F.col(t + "zone")).withColumn(
        t + "y", F.when(F.col(t + "z").isNotNull(), F.least(F.greatest(year, F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)))
    )
    joined = keyed.join(F.broadcast(spans), [t + "z", t + "y"], "left")
    us = F.col(t + "us")
    hits = F.filter(t + "s", lambda x: (x["local_from"] <= us) & (us < x["local_to"]))
    before = F.filter(t + "s", lambda x: x["local_to"] <= us)
    offset = (
        F.when(F.col(t + "zone").isNull(), F.col(t + "offset"))
        .when(F.size(hits) > 0, hits[0]["offset_s"])
        .when(F.size(before) > 0, F.element_at(before, -1)["offset_s"])
    )
    instant = us - offset.cast("long") * 1000000
    note = F.when(F.col(t + "zone").isNull() | (F.size(hits) == 1), "exact").when(F.size(hits) > 1, "ambiguous").otherwise("nonexistent")
    out = joined.withColumn("instant_us", instant)
    return out.select(
        *[F.col(f"`{x}`") for x in df.columns],
        "instant_us",
        F.timestamp_micros("instant_us").cast("date").alias("utc_day"),
        F.when(F.col("instant_us").isNotNull(), note).alias("zone_note"),
    )


def utc_text(instant_us: Column) -> Column:
    """Microseconds since 1970 as ``yyyy-MM-ddTHH:mm:ss.ffffff`` (the session zone must be UTC)."""
    return F.date_format(F.timestamp_micros(instant_us), UTC_FORM)


def is_canonical(column: Column) -> Column:
    return column.rlike(timeparse.CANONICAL)


def normalise_timestamps(
    df: DataFrame, sources: DataFrame | None = None, key: str = "review_id", column: str = "published_at", source_column: str = "source"
) -> DataFrame:
    """One row per ``key``: (key, published_utc, rewritten, zone_note).

    ``published_utc`` is null where the value names no instant; ``rewritten`` tells whether the stored
    value differs from the canonical form. Of repeated deliveries one is read (their timestamps agree;
    if they do not, the smallest value in string order counts). Rows with a null key are left out.
    """
    c = F.col(column).cast("string")
    one = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(c.alias("c"), F.col(source_column).alias("s"))).alias("m"))
        .select(key, F.col("m.c").alias(column), F.col("m.s").alias(source_column))
    )
    out = with_instants(one, sources, column, source_column)
    return out.select(
        key,
        utc_text(F.col("instant_us")).alias("published_utc"),
        (~F.coalesce(is_canonical(F.col(column)), F.lit(False))).alias("rewritten"),
        "zone_note",
    )
