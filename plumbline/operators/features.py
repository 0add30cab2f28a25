"""One row per entity from events: counts, recency and totals, also per event type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_type_table(df: DataFrame, entity: str, kind: str, day: str = "utc_day", value: str | None = "rating") -> DataFrame:
    """The compact long table: one row per (entity, type) that occurs.

    Columns: ``event_count``, ``dated_count``, ``first_day``, ``last_day``, ``value_sum``,
    ``value_count``. A null type is a type of its own; rows with a null entity are left out. Undated
    events count in ``event_count`` only. Aggregation starts before the shuffle, so an entity or type
    that holds a third of all rows reaches the reducers as one row per task.
    """
    v = F.col(value) if value else F.lit(None).cast("int")
    return (
        df.where(F.col(entity).isNotNull())
        .groupBy(entity, kind)
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count(day).alias("dated_count"),
            F.min(day).alias("first_day"),
            F.max(day).alias("last_day"),
            F.sum(v.cast("long")).alias("value_sum"),
            F.count(v).alias("value_count"),
        )
    )


def type_list(long: DataFrame, kind: str, most: int | None = 1000) -> list[str]:
    """The types that occur, in order; more than ``most`` is an error, never a cut. None: all, whatever their number."""
    kinds = long.where(F.col(kind).isNotNull()).select(kind).distinct()
    found = [r[0] for r in (kinds if most is None else kinds.limit(most + 1)).collect()]
    if most is not None and len(found) > most:
        raise ValueError(f"more than {most} types; pass an explicit list")
    return sorted(found)


#: What stands for each type beside its event count, named as the totals are.
PER_TYPE = ("dated_count", "first_day", "last_day", "active_period_days", "recency_days", "rating_sum", "rating_avg")


def _measures(kept: dict[str, Column], as_of: str | None) -> dict[str, Column]:
    """The columns of PER_TYPE from summed ``entity_type_table`` columns; counts and sums 0 where none."""
    span = F.datediff(kept["last_day"], kept["first_day"])
    return {
        "dated_count": F.coalesce(kept["dated_count"], F.lit(0)),
        "first_day": kept["first_day"],
        "last_day": kept["last_day"],
        "active_period_days": F.when(span.isNotNull(), F.greatest(F.lit(1), span)),
        "recency_days": F.datediff(F.lit(as_of).cast("date"), kept["last_day"]),
        "rating_sum": kept["value_sum"],
        "rating_avg": kept["value_sum"] / F.nullif(kept["value_count"], F.lit(0)),
    }


def entity_features(
    long: DataFrame, entity: str, kind: str, types: list[str], as_of: str | None = None, prefix: str = "n_"
) -> DataFrame:
    """One row per entity, from ``entity_type_table``.

    ``review_count``, ``dated_count``, ``first_day``, ``last_day``, ``active_period_days`` (1 for a
    single date, else the days between first and last; null without dates), ``recency_days`` (from
    ``last_day`` to ``as_of``; null without either), ``rating_sum`` (null without ratings),
    ``rating_avg``. For each of ``types`` the same: ``<prefix><type>`` with the event count (0 where
    none) and ``<name>_<type>`` for each name of ``PER_TYPE``. Types outside the list and the null type
    count in the totals and together as the type ``other``. A type that repeats is used once; for names that
    are taken see ``type_labels``.
    """
    names = list(dict.fromkeys(types))
    labels = type_labels(names)
    at = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(kind)), F.lit(0)) if names else F.lit(0)
    # all types of an entity in one task, at most one row each, so the wide rows are never shuffled; each row
    # also counts for the totals, which are one more value of the pivot
    own = long.repartition(entity).withColumn("__k", F.explode(F.array(at.cast("int"), F.lit(-1))))
    # days go through the pivot as numbers: its fast form takes no dates
    numbers = {"event_count": F.sum("event_count"), "dated_count": F.sum("dated_count"), "first_day": F.min(F.unix_date("first_day")),
               "last_day": F.max(F.unix_date("last_day")), "value_sum": F.sum("value_sum"), "value_count": F.sum("value_count")}
    wide = own.groupBy(entity).pivot("__k", list(range(-1, len(names) + 1))).agg(*[v.alias(c) for c, v in numbers.items()])

    def kept(k: int) -> dict[str, Column]:
        return {c: F.col(f"`{k}_{c}`") for c in numbers} | {c: F.date_from_unix_date(F.col(f"`{k}_{c}`")) for c in ("first_day", "last_day")}

    columns = [kept(-1)["event_count"].alias("review_count"), *[v.alias(c) for c, v in _measures(kept(-1), as_of).items()]]
    for k, n in [*enumerate(labels[:-1], 1), (0, labels[-1])]:
        columns.append(F.coalesce(kept(k)["event_count"], F.lit(0)).alias(prefix + n))
        columns += [v.alias(f"{c}_{n}") for c, v in _measures(kept(k), as_of).items()]
    return wide.select(entity, *columns)


def type_labels(types: list[str], rest: str = "other") -> list[str]:
    """How the columns of the types and of the rest are named: as the type, with ``_2``, ``_3`` ... where that name, in any
    case, is taken."""
    taken: set[str] = set()
    out = []
    for n in [*types, rest]:
        name, i = n, 1
        while name.lower() in taken:
            i += 1
            name = f"{n}_{i}"
        taken.add(name.lower())
        out.append(name)
    return out


def by_type(features: DataFrame, entity: str, types: list[str], prefix: str = "n_") -> DataFrame:
    """The rows of ``entity_features`` turned back: one per (entity, ``type``) with events, named as the totals are."""
    names = list(dict.fromkeys(types))
    cell = lambda n, label: F.struct(F.lit(n).alias("type"), F.col(f"`{prefix}{label}`").alias("review_count"), *[F.col(f"`{c}_{label}`").alias(c) for c in PER_TYPE])
    cells = F.array(*[cell(n, label) for n, label in zip(names, type_labels(names), strict=False)])
    return features.select(entity, F.explode(F.filter(cells, lambda x: x["review_count"] > 0)).alias("x")).select(entity, "x.*")


def types_where(features: DataFrame, entity: str, kind: str, types: list[str], test: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """The pairs (entity, ``kind``) of ``types`` whose columns in ``entity_features`` pass ``test``, which takes a name of
    PER_TYPE to the type's column. What it does not ask for need not be computed."""
    names = list(dict.fromkeys(types))
    passed = []
    for n, label in zip(names, type_labels(names), strict=False):
        quoted = label.replace("`", "``")
        passed.append(F.when(test(lambda c, q=quoted: F.col(f"`{c}_{q}`")), F.lit(n)))
    return features.select(entity, F.explode(F.array_compact(F.array(*passed).cast("array<string>"))).alias(kind))
