"""Trailing windows over calendar days, idle days included.

Each entity's calendar runs from its first to its last active day. Inside sorted partitions a
two-stack queue holds the active window: the back stack keeps suffix aggregates of the days that leave
next, the front stack a running aggregate of the days that came last. The stacks turn over at every
multiple of the window length, so all turns of all entities are done at once with array operations,
and only an associative operation with an identity is needed: sums as well as minima and maxima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONOIDS = {"sum": (np.add, 0.0), "min": (np.minimum, np.inf), "max": (np.maximum, -np.inf)}
SLICE = 50_000


def two_stack(values: np.ndarray, lengths: np.ndarray, window: int, how: str) -> np.ndarray:
    """Trailing aggregate over ``window`` positions within each run of ``lengths`` positions."""
    op, unit = MONOIDS[how]
    padded = -(-lengths // window) * window
    start_in, start_out = np.cumsum(lengths) - lengths, np.cumsum(padded) - padded
    at = np.arange(len(values)) + np.repeat(start_out - start_in, lengths)
    grid = np.full(int(padded.sum()), unit)
    grid[at] = values
    grid = grid.reshape(-1, window)
    front = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    inside = np.arange(len(values)) - np.repeat(start_in, lengths)
    out = front[at]
    split = (inside >= window) & (inside % window != window - 1)  # the window spans a turn of the stacks
    out[split] = op(back[at[split] - window + 1], out[split])
    return out


def _daily(batches: Iterator[pa.RecordBatch], windows: list[int], measures: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Sorted (entity, day, measures...) rows to calendars with trailing aggregates."""

    def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
        day = t.column(1).to_numpy().astype(np.int64)
        entity = t.column(0).combine_chunks()
        if isinstance(entity, pa.ChunkedArray):
            entity = pa.concat_arrays(entity.chunks)
        code = entity.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        last = np.r_[first[1:] - 1, len(code) - 1]
        lengths = day[last] - day[first] + 1
        columns = [c.to_numpy().astype(float) for c in t.columns[2:]]
        lo = 0
        while lo < len(first):  # bounded pieces of whole calendars
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(lengths[lo:]), 20 * SLICE, "right")) + lo)
            part = slice(first[lo], last[hi - 1] + 1)
            n = lengths[lo:hi]
            base = np.cumsum(n) - n
            owner = np.repeat(np.arange(hi - lo), n)
            which = np.repeat(np.arange(hi - lo), last[lo:hi] - first[lo:hi] + 1)
            where = day[part] - day[first[lo:hi]][which] + base[which]
            made = []
            for (_, how), column in zip(measures, columns, strict=True):
                dense = np.full(int(n.sum()), MONOIDS[how][1])
                dense[where] = np.where(np.isnan(column[part]), MONOIDS[how][1], column[part])
                made.append(dense)
                made += [two_stack(dense, n, w, how) for w in windows]
            days = np.arange(int(n.sum())) - base[owner] + day[first[lo:hi]][owner]
            number = np.arange(int(n.sum())) - base[owner] + 1
            for a in range(0, len(days), SLICE):
                b = slice(a, a + SLICE)
                keys = entity.take(pa.array(first[lo:hi][owner[b]]))
                arrays = [keys, pa.array(days[b].astype(np.int32)).cast(pa.date32()), pa.array(number[b].astype(np.int32))]
                for x in made:
                    x = x[b]
                    arrays.append(pa.array(x, mask=~np.isfinite(x)))
                yield pa.RecordBatch.from_arrays(arrays, names=[str(i) for i in range(len(arrays))])
            lo = hi

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        names = held.column(0)
        tail = names[len(names) - 1]
        cut = pc.index(names, tail).as_py()  # rows of the last entity wait for the next batch
        if cut:
            yield from finish(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield from finish(held)


def rolling_days(
    events: DataFrame,
    entity: str,
    day: str,
    value: str,
    windows: tuple[int, ...] = (7, 30),
) -> DataFrame:
    """One row per entity and calendar day from its first to its last dated event.

    Columns: entity, ``activity_day`` (date), ``day_number`` (1 on the first day), ``events`` and for
    each window w ``events_w``, ``value_sum_w``, ``value_avg_w``, ``value_min_w``, ``value_max_w`` over
    the last w days, this one included. Before day w the window holds the days there are. Null values
    count as events but not in the value columns, which are null where a window has no value (the sum
    is 0). Events with a null entity or day are left out. Events are summed per entity and day before
    they are shuffled, so the largest group is one entity's active days, not its events.
    """
    v = F.col(value).cast("double")
    daily = (
        events.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(day).alias("d"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("events"),
            F.count(v).cast("double").alias("valued"),
            F.sum(v).alias("value_sum"),
            F.min(v).alias("value_min"),
            F.max(v).alias("value_max"),
        )
        .select("entity", F.unix_date("d").alias("d"), "events", "valued", "value_sum", "value_min", "value_max")
        .repartition("entity")
        .sortWithinPartitions("entity", "d")
    )
    measures = [("events", "sum"), ("valued", "sum"), ("value_sum", "sum"), ("value_min", "min"), ("value_max", "max")]
    ws = list(windows)
    schema = "entity string, activity_day date, day_number int, " + ", ".join(
        f"`{m}{s}` double" for m, _ in measures for s in ["", *[f"_{w}" for w in ws]]
    )
    wide = daily.mapInArrow(lambda it: _daily(it, ws, measures), schema)
    columns = [F.col("entity").alias(entity), "activity_day", "day_number", F.col("events").cast("long").alias("events")]
    for w in ws:
        columns += [
            F.col(f"events_{w}").cast("long").alias(f"events_{w}"),
            F.col(f"value_sum_{w}"),
            (F.col(f"value_sum_{w}") / F.nullif(F.col(f"valued_{w}"), F.lit(0.0))).alias(f"value_avg_{w}"),
            F.col(f"value_min_{w}"),
            F.col(f"value_max_{w}"),
        ]
    return wide.select(*columns)
