"""The most similar vectors for every vector, by stable projections and kd-trees.

Unit vectors are projected on ``PROJECTED`` Gaussian directions, which keep distances up to a factor whose
square is chi-square distributed. kd-trees over independent rotations of the projections (cut at medians of
a bounded sample, and further inside of a task) bring near vectors into common leaves. Inside of a leaf the
neighbours of a vector come in order of projected distance and are accepted for verification until the
chi-square test says that no vector as near as asked can be that far away in the projection. Verified
means: the cosine of the full vectors. A vector with few such neighbours has them verified pair by pair; where
many stand close together, their full vectors are brought to the leaf once and verified there, so only the
nearest leave it.

Exact copies are one vector to the search and come back in the result, by their smallest ids.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import drop_materialised, materialise

PROJECTED = 48
LEAF = 8192
SAMPLE = 20_000
MISS = 0.02  # of the stopping test, on either side
PAIRS = 96  # accepted neighbours of a vector in a leaf beyond which it is verified in the leaf
_STEP = 1 / 28  # of the stored projections


def chi_square(p: float, m: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    z = NormalDist().inv_cdf(p)
    return m * (1 - 2 / (9 * m) + z * math.sqrt(2 / (9 * m))) ** 3


def pack_vector(x: np.ndarray) -> list[bytes]:
    """Rows of float64 in the narrowest IEEE width that gives the same numbers back, deflated."""
    with np.errstate(over="ignore"):
        half, single = x.astype("<f2"), x.astype("<f4")
    fits2, fits4 = (half == x).all(axis=1), (single == x).all(axis=1)
    return [
        (b"2" + zlib.compress(half[i].tobytes(), 1)) if fits2[i] else (b"4" + zlib.compress(single[i].tobytes(), 1)) if fits4[i] else (b"8" + x[i].astype("<f8").tobytes())
        for i in range(len(x))
    ]


def unpack_vector(b: bytes) -> np.ndarray:
    body = b[1:] if b[:1] == b"8" else zlib.decompress(b[1:])
    return np.frombuffer(body, "<f" + b[:1].decode()).astype(np.float64)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of the lists with ``dim`` finite values that are not all zero."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(-1))
    flat = column.flatten()
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero(lengths == dim)
    x = values[starts[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0


def _classes(x: np.ndarray) -> list[bytes]:
    r = np.round(_unit(x), 7) + 0.0
    return [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in r]


def _project(dim: int, seed: int):
    directions = np.random.default_rng(seed).standard_normal((dim, PROJECTED)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column(1), dim)
            p = np.clip(np.round(_unit(x).astype(np.float32) @ directions / _STEP), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(_classes(x), pa.binary()), pa.array([v.tobytes() for v in p], pa.binary())],
                names=["id", "class", "proj"],
            )

    return run


def _encode(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(_classes(x), pa.binary()), pa.array(pack_vector(x), pa.binary())], names=["class", "code"])

    return run


def _points(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.int8).reshape(-1, PROJECTED).astype(np.float32) * np.float32(_STEP)


def rotations(trees: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed + 1)
    return [np.linalg.qr(rng.standard_normal((PROJECTED, PROJECTED)))[0].astype(np.float32) for _ in range(trees)]


def build_tree(sample: np.ndarray, depth: int) -> np.ndarray:
    """Cut values of a complete tree, node by node; level k cuts coordinate k."""
    cuts = np.zeros((1 << depth) - 1, np.float32)
    node = np.zeros(len(sample), np.int64)
    for level in range(depth):
        base = (1 << level) - 1
        for v in np.unique(node):
            cuts[base + v] = np.median(sample[node == v, level % PROJECTED])
        node = node * 2 + (sample[:, level % PROJECTED] > cuts[base + node])
    return cuts


def leaf_of(points: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for level in range(depth):
        node = node * 2 + (points[:, level % PROJECTED] > cuts[(1 << level) - 1 + node])
    return node


def _leaf_pairs(points: np.ndarray, k: int, reach: float, spread: float, level: int = 0) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Leaf by leaf: its positions and, block by block, the pairs (of positions in the leaf) that pass the stopping test, in order of the first."""
    if len(points) > LEAF and level < PROJECTED:
        axis = PROJECTED - 1 - level  # coordinates that the upper tree uses last
        right = points[:, axis] > np.median(points[:, axis])
        if not right.any() or right.all():
            yield from _leaf_pairs(points, k, reach, spread, level + 1)
            return
        for side in (~right, right):
            at = np.flatnonzero(side)
            for own, blocks in _leaf_pairs(points[at], k, reach, spread, level + 1):
                yield at[own], blocks
        return
    norm = (points**2).sum(axis=1)
    # one product gives p.q - |q|^2 / 2, so a distance is compared without a further pass over the block
    wide = np.concatenate([points, -norm[:, None] / 2], axis=1)
    blocks = []
    for lo in range(0, len(points), 1024):
        part = np.concatenate([points[lo : lo + 1024], np.ones((len(points[lo : lo + 1024]), 1), np.float32)], axis=1)
        m = part @ wide.T
        m[np.arange(len(part)), np.arange(lo, lo + len(part))] = -np.inf
        flat = np.flatnonzero(m >= (norm[lo : lo + 1024, None] - reach) / 2)
        if not len(flat):
            continue
        i, j = flat // len(points), flat % len(points)
        dist = norm[lo + i] - 2 * m.ravel()[flat]
        order = np.lexsort((dist, i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1]
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        stop = np.full(len(part), np.inf)
        kth = rank == k - 1
        stop[i[kth]] = dist[kth] * spread
        keep = dist <= stop[i]
        blocks.append((i[keep] + lo, j[keep]))
    yield np.arange(len(points)), blocks


def _search(k: int, reach: float, spread: float):
    """Rows (cell, leaf, a, b, ask): a pair to verify; or, without b, a vector that its leaf needs and whether it asks there."""

    def run(t: pa.Table) -> pa.Table:
        names = np.array(t.column("class").combine_chunks().to_pylist(), dtype=object)
        cell = t.column("cell")[0].as_py() if t.num_rows else 0
        out: list[pa.RecordBatch] = []

        def put(leaf: int, a: np.ndarray, b: np.ndarray | None, ask: np.ndarray | None) -> None:
            n = len(a)
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, cell, np.int64)), pa.array(np.full(n, leaf, np.int32)), pa.array(names[a], pa.binary()),
                 pa.nulls(n, pa.binary()) if b is None else pa.array(names[b], pa.binary()), pa.nulls(n, pa.bool_()) if ask is None else pa.array(ask)],
                schema=_FOUND,
            ))

        for leaf, (own, blocks) in enumerate(_leaf_pairs(_points(t.column("rotated")), k, reach, spread)):
            pairs, asks, needed = [], np.zeros(len(own), bool), np.zeros(len(own), bool)
            for i, j in blocks:
                many = np.bincount(i, minlength=len(own)) > PAIRS
                asks |= many
                dense = many[i]
                needed[j[dense]] = True
                i, j = i[~dense], j[~dense]
                pairs.append(np.minimum(i, j) * len(own) + np.maximum(i, j))
            both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            a, b = own[both // len(own)], own[both % len(own)]
            swap = np.array([p > q for p, q in zip(names[a], names[b], strict=True)], bool)
            put(leaf, np.where(swap, b, a), np.where(swap, a, b), None)
            members = np.flatnonzero(asks | needed)
            put(leaf, own[members], None, asks[members])
        return pa.Table.from_batches(out, _FOUND)

    return run


_FOUND = pa.schema([("cell", pa.int64()), ("leaf", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("ask", pa.bool_())])


def _nearest_in_leaf(k: int, min_cosine: float):
    """The ``k`` nearest of each asking vector among the vectors of its leaf, those as near as the last one included."""

    def run(t: pa.Table) -> pa.Table:
        names = t.column("class").combine_chunks().to_pylist()
        x = np.stack([unpack_vector(c) for c in t.column("code").to_pylist()])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        asking = np.flatnonzero(t.column("ask").to_numpy(zero_copy_only=False))
        a, b, c = [], [], []
        for lo in range(0, len(asking), 512):
            rows = asking[lo : lo + 512]
            cos = np.round(x[rows] @ x.T, 12)
            cos[np.arange(len(rows)), rows] = -2
            least = np.partition(cos, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)]
            i, j = np.nonzero(cos >= np.maximum(least, min_cosine)[:, None])
            for p, q, s in zip(rows[i].tolist(), j.tolist(), cos[i, j].tolist(), strict=True):
                u, v = sorted((names[p], names[q]))
                a.append(u), b.append(v), c.append(s)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "cosine": pa.array(c, pa.float64())})

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cos = []
        for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            u, v = unpack_vector(p), unpack_vector(q)
            u, v = u / np.abs(u).max(), v / np.abs(v).max()
            cos.append(float(u @ v) / math.sqrt(float(u @ u) * float(v @ v)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(cos, 12), pa.float64())], names=["a", "b", "cosine"])


def trees_needed(n: int, min_cosine: float, recall: float) -> tuple[int, int]:
    """(depth, trees) so that a pair at the least cosine shares a leaf of some tree with ``recall``."""
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    if not depth:
        return 0, 1
    together = (1 - math.acos(min_cosine) / math.pi) ** depth
    return depth, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def similar_vectors(
    df: DataFrame, key: str, vector: str, dim: int, k: int = 5, min_cosine: float = 0.8, recall: float = 0.9, seed: int = 11
) -> DataFrame:
    """One row (key, ``neighbour``, ``cosine``, ``rank``) for each of the up to ``k`` nearest other keys
    with at least ``min_cosine`` (above 0). Equal cosines: the smaller key first.

    Vectors count that have ``dim`` finite values, not all zero; of several vectors of one key one is
    taken, the same in every run. Null keys are left out. ``recall`` is the least expected recall for
    pairs at ``min_cosine``; nearer pairs are found more surely. Every vector is indexed; only the cuts
    of the trees come from a sample of about ``SAMPLE`` of them. An empty table gives no rows.
    """
    spark = df.sparkSession
    base = df.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = base.mapInArrow(_project(dim, seed), "id string, class binary, proj binary")
    one = materialise(rows.groupBy("id").agg(F.min(F.struct("class", "proj")).alias("m")).select("id", "m.class", "m.proj"), "vectors")
    points = materialise(one.groupBy("class").agg(F.first("proj").alias("proj"), F.count(F.lit(1)).alias("n")), "points")
    n = points.count()
    depth, trees = trees_needed(n, min_cosine, recall)
    sampled = points.select("proj").where(F.rand(seed) < SAMPLE / max(n, 1)).limit(4 * SAMPLE).collect() if depth else []
    turn = rotations(trees, seed)
    sample = _points(pa.array([bytes(r[0]) for r in sampled], pa.binary())) if sampled else np.zeros((0, PROJECTED), np.float32)
    depth = min(depth, max(0, int(math.log2(max(1, len(sample)) / 8))))
    cuts = [build_tree(sample @ r, depth) for r in turn]

    def spread_over_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(batch.column(1))
            for t in range(trees):
                y = x @ turn[t]
                q = np.clip(np.round(y / _STEP), -127, 127).astype(np.int8)
                cell = leaf_of(y, cuts[t], depth) + (t << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), batch.column(0), pa.array([v.tobytes() for v in q], pa.binary())], names=["cell", "class", "rotated"]
                )

    reach = 2 * (1 - min_cosine) * chi_square(1 - MISS, PROJECTED)
    test = chi_square(1 - MISS, PROJECTED) / chi_square(MISS, PROJECTED)
    found = (
        points.select("class", "proj")
        .mapInArrow(spread_over_trees, "cell long, class binary, rotated binary")
        .groupBy("cell")
        .applyInArrow(_search(k, reach, test), "cell long, leaf int, a binary, b binary, ask boolean")
    )
    found = materialise(found, "found")
    pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
    codes = base.select("id", "v").mapInArrow(_encode(dim), "class binary, code binary").groupBy("class").agg(F.first("code").alias("code"))
    first = pairs.join(codes.select(F.col("class").alias("a"), F.col("code").alias("code_a")), "a")
    both = first.join(codes.select(F.col("class").alias("b"), F.col("code").alias("code_b")), "b")
    verified = both.select("a", "b", "code_a", "code_b").mapInArrow(_cosines, "a binary, b binary, cosine double").where(F.col("cosine") >= min_cosine)
    crowded = found.where("b IS NULL").select("cell", "leaf", F.col("a").alias("class"), "ask").join(codes, "class")
    nearest = crowded.groupBy("cell", "leaf").applyInArrow(_nearest_in_leaf(k, min_cosine), "a binary, b binary, cosine double")
    close = materialise(verified.union(nearest).dropDuplicates(["a", "b"]), "cosines")
    drop_materialised(found)
    heads = (
        one.select("class", "id")
        .withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id")))
        .where(F.col("r") <= k + 1)
        .select(F.col("class").alias("t"), "id")
    )
    copies = points.where("n > 1").select(F.col("class").alias("c"), F.col("class").alias("t"), F.lit(1.0).alias("cosine"))
    links = close.select(F.col("a").alias("c"), F.col("b").alias("t"), "cosine").unionByName(
        close.select(F.col("b").alias("c"), F.col("a").alias("t"), "cosine")
    ).unionByName(copies)
    near = (
        links.join(heads, "t")
        .withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cosine"), "id")))
        .where(F.col("r") <= k + 1)
        .groupBy("c")
        .agg(F.sort_array(F.collect_list(F.struct("r", "id", "cosine"))).alias("near"))
    )
    kind = df.schema[key].dataType
    own = one.select(F.col("class").alias("c"), F.col("id").alias("x")).join(near, "c")
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("x")), 1, k)
    return own.select("x", F.posexplode(others).alias("p", "e")).select(
        F.col("x").cast(kind).alias(key), F.col("e.id").cast(kind).alias("neighbour"), F.col("e.cosine").alias("cosine"), (F.col("p") + 1).alias("rank")
    )


def neighbour_pairs(neighbours: DataFrame, key: str) -> DataFrame:
    """Unordered pairs of which at least one is a neighbour of the other: (<key>_a, <key>_b), a < b."""
    x, y = F.col(key), F.col("neighbour")
    return neighbours.select(F.least(x, y).alias(f"{key}_a"), F.greatest(x, y).alias(f"{key}_b")).distinct()
