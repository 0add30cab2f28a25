"""Consolidating pairwise matches into groups.

Every task runs union-find over its own part of the edges and keeps only a spanning forest: one edge from
each vertex to the root of its tree. While all forest edges together exceed what one task may hold, the
forests are contracted: a vertex moves to the first of its roots in the random order of the round, and what
remains is a graph of roots only, cut into partitions and treated the same way. Roots are the first of
their trees in that order, so a round keeps at most about two thirds of the vertices, whatever the shape of
the graph, and a chain of n edges takes O(log n) rounds. What fits is merged in one bounded partition; the
labels then go back down the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.timeparse import strip
from plumbline.session import drop_materialised, materialise

#: Forest edges that one task may hold; about 100 bytes each.
EDGES_PER_TASK = 2_000_000
#: Vertices that share a label go through a broadcast of that label where they are more than this.
HOT = 1_000_000
_TREES = "v string, r string, h long"


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each vertex's tree, by hooking roots to smaller roots and halving paths."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _priority(names: np.ndarray, turn: int | None) -> np.ndarray:
    """The random order of a round; none: string order."""
    if turn is None:
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(np.array([s.encode() for s in names], dtype=object))] = np.arange(len(names))
        return rank
    return (pd.util.hash_array(names, hash_key=f"{turn:016d}", categorize=False) >> np.uint64(1)).astype(np.int64)


def _forests(bound: int, turn: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (v, r) to the spanning forest of the partition: (v, r, h), h the root's place in the order of
    the round, with a row for each root itself. At most about ``bound`` edges are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def merge() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ends = pa.concat_arrays([*t.column(0).chunks, *t.column(1).chunks]).dictionary_encode()
            names, codes = ends.dictionary.to_numpy(zero_copy_only=False).astype(object), ends.indices.to_numpy()
            h = _priority(names, turn)
            order = np.lexsort((_priority(names, None), h)) if len(np.unique(h)) < len(h) else np.argsort(h)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            v = place[codes]
            half = len(v) // 2
            root = forest(v[:half], v[half:], len(order))
            named = names[order]
            return pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array(named[root], pa.string()), pa.array(h[order][root], pa.int64())], names=["v", "r", "h"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(["v", "r"]))
                rows += batch.num_rows
                if rows > bound:
                    done = merge()
                    if done.num_rows * 2 > bound:  # a forest this large is handed on
                        yield done
                        held = []
                    else:
                        held = [done.select(["v", "r"])]
                    rows = sum(x.num_rows for x in held)
        if held:
            yield merge()

    return run


def relabelled(own: DataFrame, upper: DataFrame) -> DataFrame:
    """(v, top) from own (v, m) and upper (m, top): each upper row has one m, any number of rows share one.

    An m with more than ``HOT`` rows is looked up by broadcast: there are at most rows / ``HOT`` of them.
    """
    hot = own.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).join(upper, "m").select("m", F.col("top").alias("hot_top"))
    marked = own.join(F.broadcast(hot), "m", "left")
    cold = marked.where("hot_top IS NULL").join(upper, "m", "left").select("v", F.coalesce("top", "m").alias("top"))
    return marked.where("hot_top IS NOT NULL").select("v", F.col("hot_top").alias("top")).union(cold)


def connected_groups(
    edges: DataFrame, a: str = "review_id_a", b: str = "review_id_b", out: str = "review_id", edges_per_task: int | None = None, rounds: list[int] | None = None
) -> DataFrame:
    """One row (``out``, ``group_id``) for every id in at least one pair of two different ids.

    Ids are compared without surrounding white space; null and blank ids and pairs of one id with itself
    link nothing. ``group_id`` is the smallest id of the group in string order. Repeated pairs, pairs in
    either order and other columns make no difference; no usable pair gives an empty result. Ids keep
    the bytes they have apart from the trimming. ``edges_per_task`` bounds what a task holds
    (``EDGES_PER_TASK``); the result does not depend on it. ``rounds`` gets the forest edges of each round.
    """
    bound = edges_per_task or EDGES_PER_TASK
    x, y = strip(F.col(a).cast("string")), strip(F.col(b).cast("string"))
    graph = edges.select(x.alias("v"), y.alias("r")).where("v != '' AND r != '' AND v != r")
    moves: list[DataFrame] = []
    while True:
        turn = len(moves)
        trees = materialise(graph.mapInArrow(_forests(bound, turn), _TREES), "forest")
        count = trees.where("v != r").count()
        if rounds is not None:
            rounds.append(count)
        if count <= bound:
            break
        # all roots of a vertex, at most one for each task before; it moves to the first of them
        roots = trees.groupBy("v").agg(F.sort_array(F.collect_set(F.struct("h", "r"))).alias("s"))
        gathered = materialise(roots.select("v", F.col("s")[0]["r"].alias("m"), F.slice("s", 2, F.size("s")).alias("s")), "roots")
        drop_materialised(trees)
        moves.append(gathered.select("v", "m"))
        graph = gathered.select("m", F.explode("s").alias("x")).select(F.col("x.r").alias("v"), F.col("m").alias("r")).distinct()
    one = materialise(trees.coalesce(1).mapInArrow(_forests(bound * 4, None), _TREES), "labels")
    drop_materialised(trees)
    if not moves:
        return one.select(F.col("v").alias(out), F.col("r").alias("group_id"))
    labels = one.select("v", F.col("r").alias("top"))
    for own in reversed(moves):
        labels = materialise(relabelled(own, labels.select(F.col("v").alias("m"), "top")), "labels")
    least = labels.groupBy("top").agg(F.min("v").alias("top2")).select(F.col("top").alias("m"), F.col("top2").alias("top"))
    named = relabelled(labels.select("v", F.col("top").alias("m")), least)
    return named.select(F.col("v").alias(out), F.col("top").alias("group_id"))


def group_lists(groups: DataFrame, member: str = "review_id", most: int = 10_000) -> DataFrame:
    """(group_id, part, review_ids): the members of each group in arrays of about ``most`` at the most.

    A group of any size is spread over parts by hash, so no row or task grows with the largest group.
    """
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") * 2 / F.lit(most)).cast("long")
    small = F.when(F.col("n") <= most, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(member), parts))
    return (
        groups.join(sizes, "group_id")
        .groupBy("group_id", small.alias("part"))
        .agg(F.sort_array(F.collect_list(member)).alias("review_ids"), F.first("n").alias("group_size"))
    )
