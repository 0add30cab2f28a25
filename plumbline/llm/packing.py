"""Filling containers of fixed capacity with items.

Sizes are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity``
entries, whatever the number of items. On it, dominance fixes sets that belong together in some best
solution: an item and one that fills its gap exactly; an item that nothing fits beside; an item beside
which at most one other fits, with the largest that does. The rest is packed best-fit, by decreasing
size. Each decision is a pattern with a number of copies; items find their container by their rank
within their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import materialise

Pattern = tuple[list[tuple[int, int]], int]


def dominance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fixes dominating sets and takes them out of ``counts`` (by size), until none is found."""
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for size in range(capacity, 0, -1):
            while counts[size]:
                gap = capacity - size
                present = np.flatnonzero(counts[1:]) + 1
                others = present if counts[size] > 1 else present[present != size]
                fitting = others[others <= gap]
                if not len(fitting):
                    uses, copies = [(size, 1)], int(counts[size])
                    if counts[size] > 1 and 2 * size <= capacity:  # unreachable unless gap >= size
                        break
                else:
                    best = int(fitting[-1])
                    least = int(fitting[0])
                    spare = counts[least] - (least == size)
                    two = least * 2 if spare > 1 else least + int(fitting[1]) if len(fitting) > 1 else capacity + 1
                    if best != gap and two <= gap:
                        break
                    if best == size:
                        uses, copies = [(size, 2)], int(counts[size] // 2)
                    else:
                        uses, copies = [(size, 1), (best, 1)], int(min(counts[size], counts[best]))
                for s, u in uses:
                    counts[s] -= u * copies
                fixed.append((uses, copies))
                again = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Packs what is left, largest items first, each into the open container with the least room that holds it.

    Containers that are filled alike are one entry, so the work grows with the number of sizes, not of items.
    """
    open_: dict[int, list[Pattern]] = {}  # by room
    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n:
            room = min((g for g in open_ if g >= size), default=capacity)
            # a container takes such items until none fits, for it has the least room all the while
            each = room // size
            uses, copies = open_[room].pop() if room in open_ else ([], -(-n // each))
            if room in open_ and not open_[room]:
                del open_[room]
            if n < each:
                each, full = n, 1
            else:
                full = min(copies, n // each)
            if copies > full and uses:
                open_.setdefault(room, []).append((uses, copies - full))
            open_.setdefault(room - each * size, []).append(([*uses, (size, each)], full))
            n -= each * full
        counts[size] = 0
    return [pattern for room in sorted(open_) for pattern in open_[room]]


def pack_sizes(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if size > 0:
            counts[size] = n
    return dominance(counts, capacity) + best_fit(counts, capacity)


def pack(items: DataFrame, key: str, size: str, capacity: int, rows_per_task: int = 1_000_000) -> DataFrame:
    """One row per piece: (key, ``piece_no``, ``piece_size``, ``container_id``).

    An item larger than ``capacity`` becomes full pieces and a rest; no other item is split. Items of
    size 0, null or below take no room and go to container 0. Containers are numbered from 0 without
    gaps. Repeated keys are separate items. Only a histogram of sizes reaches the driver, at most
    ``capacity`` numbers; ranks are counted within (size, salt), so a size that a third of all items
    share is spread over groups of about ``rows_per_task``.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    whole = F.floor(n / capacity).cast("int")
    rest = (n % capacity).cast("int")
    sizes = F.when(n == 0, F.array(F.lit(0))).otherwise(
        F.concat(F.array_repeat(F.lit(capacity), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    )
    pieces = materialise(
        items.select(F.col(key), F.posexplode(sizes).alias("p", "piece_size"))
        .select(key, (F.col("p") + 1).alias("piece_no"), "piece_size"),
        "pieces",
    )
    salts = max(1, -(-pieces.count() // rows_per_task))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)))
    cells = pieces.where("piece_size > 0").groupBy("piece_size", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["piece_size"]: r["n"] for r in cells.groupBy("piece_size").agg(F.sum("n").alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for uses, copies in pack_sizes(histogram, capacity):
        for s, u in uses:
            runs.setdefault(s, []).append((used.get(s, 0), u, first))
            used[s] = used.get(s, 0) + u * copies
        first += copies
    table = {s: np.array(x, np.int64) for s, x in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            where = np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes):
                if s > 0:
                    own = sizes == s
                    run = table[int(s)]
                    i = np.searchsorted(run[:, 0], ranks[own], "right") - 1
                    where[own] = run[i, 2] + (ranks[own] - run[i, 0]) // run[i, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(where)], names=[key, "piece_no", "piece_size", "container_id"])

    offsets = cells.select(
        "piece_size",
        "salt",
        (F.sum("n").over(Window.partitionBy("piece_size").orderBy("salt")) - F.col("n")).alias("base"),
    )
    order = Window.partitionBy("piece_size", "salt").orderBy(key, "piece_no")
    ranked = (
        pieces.withColumn("rn", F.row_number().over(order) - 1)
        .join(offsets, ["piece_size", "salt"], "left")
        .select(key, "piece_no", "piece_size", (F.coalesce("base", F.lit(0)) + F.col("rn")).alias("rank"))
    )
    kind = items.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {kind}, piece_no int, piece_size int, container_id long")


def summary(pieces: DataFrame, key: str, capacity: int) -> DataFrame:
    """One row: items, pieces and tokens packed, containers beyond ``capacity``, numbers that no container has, pieces
    in excess of the fewest, and whether there are at most 2 % (and one) more containers than the tokens fill."""
    held = pieces.where("piece_size > 0")
    fill = held.groupBy("container_id").agg(F.sum("piece_size").alias("full"))
    per = held.groupBy(key).agg(F.sum("piece_size").alias("n"), F.count(F.lit(1)).alias("k"))
    boxes = fill.agg(F.count(F.lit(1)).alias("boxes"), F.max("container_id").alias("last"), F.count_if(F.col("full") > capacity).alias("overfull"))
    items = per.agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.col("k") - F.ceil(F.col("n") / capacity)), F.lit(0)).alias("needless_cuts"),
    )
    return items.crossJoin(boxes).select(  # one row by one row
        "items", "pieces", "tokens", "overfull", (F.coalesce(F.col("last") + 1, F.lit(0)) - F.col("boxes")).alias("missing_numbers"), "needless_cuts",
        (F.col("boxes") <= F.ceil(F.col("tokens") / capacity) * 1.02 + 1).alias("tight"),
    )
