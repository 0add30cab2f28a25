"""Topic clusters of the places whose reviews all have a vector, and the phrases that stand for a group of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.texts import content_tokens, ngrams
from plumbline.session import materialise


def complete_places(rv: DataFrame, vectors: DataFrame, least: int = 2) -> DataFrame:
    """(place_id, review_id, embedding) of the places with at least ``least`` reviews that all have a vector.

    One review without a vector leaves its place out. ``vectors``: (review_id, embedding), one row per review.
    """
    own = rv.select("place_id", "review_id").where("place_id IS NOT NULL")
    have = own.join(vectors.select("review_id"), "review_id").groupBy("place_id").agg(F.count(F.lit(1)).alias("k"))
    need = own.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    whole = have.join(need, "place_id").where((F.col("k") == F.col("n")) & (F.col("n") >= least)).select("place_id")
    kept = materialise(own.join(whole, "place_id", "left_semi"), "kept")
    # only the vectors of these reviews move
    there = vectors.join(kept.select("review_id"), "review_id", "left_semi")
    return kept.join(there, "review_id").select("place_id", "review_id", "embedding")


def mutual_reachability_tree(x: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (from, to, distance) of a minimum spanning tree under mutual reachability, shortest first."""
    n = len(x)
    sq = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside = np.zeros(n, bool)
    near, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (reach[at] < near)
        near[closer], parent[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((parent[at], at, near[at]))
    a, b, w = (np.array(v) for v in zip(*edges, strict=True))
    order = np.argsort(w, kind="stable")
    return a[order], b[order], w[order]


def density_clusters(x: np.ndarray, least: int = 5, samples: int = 3) -> np.ndarray:
    """A cluster number for each point, -1 for noise: hierarchical density clusters with the largest stability.

    The tree of merges is condensed to clusters of at least ``least`` points; a cluster is kept where it lives
    longer, summed over its points, than its parts together. The whole set is never a cluster.
    """
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    a, b, w = mutual_reachability_tree(x, samples)
    # merges: node n + i joins the nodes that hold the ends of edge i
    top, size, kids, height = list(range(n)), [1] * n, [None] * n, [0.0] * n

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(n - 1):
        p, q = find(int(a[i])), find(int(b[i]))
        node = n + i
        top[p] = top[q] = node
        top.append(node), size.append(size[p] + size[q]), kids.append((p, q)), height.append(float(w[i]))

    def points(node: int) -> list[int]:
        found, stack = [], [node]
        while stack:
            v = stack.pop()
            found.append(v) if kids[v] is None else stack.extend(kids[v])
        return found

    rate = lambda h: 1.0 / max(h, 1e-12)
    members: list[list[int]] = []
    stability: list[float] = []
    parts: list[list[int]] = []
    stack = [(2 * n - 2, 0.0, -1)]
    while stack:
        node, born, above = stack.pop()
        me = len(members)
        members.append(points(node)), stability.append(0.0), parts.append([])
        if above >= 0:
            parts[above].append(me)
        while True:
            left, right = kids[node]
            at = rate(height[node])
            big = [c for c in (left, right) if size[c] >= least]
            if len(big) == 2:
                stability[me] += size[node] * (at - born)
                stack += [(left, at, me), (right, at, me)]
                break
            stability[me] += sum(size[c] for c in (left, right) if size[c] < least) * (at - born)
            if not big:
                break
            node = big[0]
    best, chosen = stability[:], [True] * len(members)
    for c in range(len(members) - 1, -1, -1):
        below = sum(best[p] for p in parts[c])
        if c == 0 or (parts[c] and below > best[c]):
            best[c], chosen[c] = below, False
    labels = np.full(n, -1)
    stack, found = list(parts[0]), 0
    while stack:
        c = stack.pop(0)
        if chosen[c]:
            labels[members[c]] = found
            found += 1
        else:
            stack += parts[c]
    return labels


def reduced(x: np.ndarray, components: int = 32) -> np.ndarray:
    """Unit vectors, centred and turned to their first principal components where they have more dimensions."""
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    keep = max(2, min(components, x.shape[1], len(x) - 1))
    if x.shape[1] <= keep:
        return x
    c = x - x.mean(axis=0)
    return c @ np.linalg.svd(c, full_matrices=False)[2][:keep].T


def _mean_cosine(x: np.ndarray) -> float:
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    n = len(u)
    return 1.0 if n < 2 else float(((u.sum(axis=0) ** 2).sum() - (u**2).sum()) / (n * (n - 1)))


def topic_clusters(complete: DataFrame, least: int = 5, samples: int = 3, fallback: float = 0.30, top: int = 5) -> DataFrame:
    """(place_id, cluster_id, review_id, similarity, to_centre, rank): the topic clusters of each place of ``complete_places``.

    Places with fewer than ``least`` reviews have none. Where nothing groups but all reviews have a mean cosine of at
    least ``fallback``, they are one cluster, numbered -1. ``similarity``: mean cosine in the cluster;
    ``to_centre``: cosine of the review with the cluster's centre; ``rank``: by that, null beyond ``top``. A place is one
    task and its distances a matrix, so places of more than about 20,000 reviews need more memory than a usual executor has.
    """

    def run(t: pa.Table) -> pa.Table:
        place, ids = t.column("place_id")[0].as_py(), t.column("review_id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        rows: list[tuple] = []
        if len(ids) >= least:
            x = reduced(np.array(t.column("embedding").to_pylist(), float)[order])
            labels = density_clusters(x, least, samples)
            groups = {int(c): np.flatnonzero(labels == c) for c in np.unique(labels) if c >= 0}
            if not groups and _mean_cosine(x) >= fallback:
                groups = {-1: np.arange(len(x))}
            for c, own in groups.items():
                u = x[own] / (np.linalg.norm(x[own], axis=1, keepdims=True) + 1e-9)
                centre = u.mean(axis=0)
                near = np.round(u @ centre / (np.linalg.norm(centre) + 1e-9), 3)
                rank = np.argsort(np.argsort(-near, kind="stable"))
                rows += [(place, c, ids[order[i]], round(_mean_cosine(x[own]), 3), float(near[k]), int(rank[k]) + 1 if rank[k] < top else None) for k, i in enumerate(own)]
        names = ["place_id", "cluster_id", "review_id", "similarity", "to_centre", "rank"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return complete.groupBy("place_id").applyInArrow(run, "place_id string, cluster_id int, review_id string, similarity double, to_centre double, rank int")


def representative_phrases(docs: DataFrame, group: str, top: int = 5, bigrams: int = 40, words: int = 30) -> DataFrame:
    """(group, phrase, n, rank): the commonest content words and bigrams of each group; ties: the smaller phrase.

    Of the bigrams only the ``bigrams`` commonest compete, of the words the ``words`` commonest. Words have at least
    two letters. Counts are taken per task before the shuffle.
    """
    t = docs.select(group, content_tokens(F.col("text"), 2).alias("t"))
    both = t.select(group, F.explode(F.concat(
        F.transform("t", lambda x: F.struct(x.alias("phrase"), F.lit(1).alias("k"))), F.transform(ngrams(F.col("t"), 2), lambda x: F.struct(x.alias("phrase"), F.lit(2).alias("k")))
    )).alias("x")).select(group, "x.*")
    counts = both.groupBy(group, "k", "phrase").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(group, "k").orderBy(F.desc("n"), "phrase")
    kept = counts.withColumn("r", F.row_number().over(own)).where(F.col("r") <= F.lit(max(bigrams, words))).where(F.col("r") <= F.when(F.col("k") == 2, bigrams).otherwise(words))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "phrase")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, "phrase", "n", "rank")


def semantic_peers(complete: DataFrame, least: float = 0.88, block: int = 2000) -> DataFrame:
    """(review_id, peers): other reviews of the place with a cosine of at least ``least``, for ``complete_places``.

    Places are cut into blocks of about ``block`` reviews; each two blocks of a place meet in one task.
    """
    size = complete.groupBy("place_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = complete.join(size, "place_id").withColumn("p", F.pmod(F.xxhash64("review_id"), F.col("blocks")).cast("int"))
    meet = dealt.select("place_id", "review_id", "embedding", "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"))
    # the block asks in cells (p, q) and is asked in cells (q, p)
    sides = meet.select("place_id", F.col("p").alias("i"), F.col("q").alias("j"), "review_id", "embedding", F.lit(True).alias("asks")).union(
        meet.select("place_id", F.col("q").alias("i"), F.col("p").alias("j"), "review_id", "embedding", F.lit(False).alias("asks"))
    )

    def run(t: pa.Table) -> pa.Table:
        asks, ids = t.column("asks").to_numpy(zero_copy_only=False), np.array(t.column("review_id").to_pylist(), object)
        x = np.array(t.column("embedding").to_pylist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        cos = x[asks] @ x[~asks].T
        n = (cos >= least).sum(axis=1) - ((ids[asks][:, None] == ids[~asks][None]) & (cos >= least)).sum(axis=1)
        return pa.table({"review_id": pa.array(ids[asks].tolist(), pa.string()), "n": pa.array(n, pa.int64())})

    counts = sides.groupBy("place_id", "i", "j").applyInArrow(run, "review_id string, n long")
    return counts.groupBy("review_id").agg(F.sum("n").alias("peers"))
