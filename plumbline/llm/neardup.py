"""Near-duplicate texts with small edits: all pairs whose character 4-gram sets are similar enough.

Texts are listed under band keys, each made of several minimum hashes, so texts above the threshold share a
list almost surely. A list that very many texts share is cut into parts, and each two parts meet in a list of
their own, so no task holds it whole. Inside of a list the entries stand in order of set size: for each entry only the block
of sizes that can still reach the threshold is visited, the rest is skipped by position, and of that block
only entries whose bit sketches agree. What remains is verified on the whole texts. Copies of a text are one
set: their answers are derived from the answers of that set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import squeeze
from plumbline.llm.components import connected_groups, relabelled
from plumbline.session import drop_materialised, materialise

GRAM = 4
BITS = 112  # of a sketch: 64 in one word, the others above the set size in the second
#: Texts of one list beyond which it is cut into parts; every pair of parts is then a list of its own.
SPLIT = 20_000
#: One key in so many is looked at to find the lists to cut.
SAMPLED = 64
#: Mean number of copies in a block of ``all_pairs``.
BLOCK = 500
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray, shift: int = 31) -> np.ndarray:
    return x ^ (x >> np.uint64(shift))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every GRAM-character window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(chars) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        h = _mix((h + chars[i : len(chars) - GRAM + 1 + i]) * _M[i % 4], 29 + i)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)[: len(h)]
    start = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.arange(len(h)) - start[owner] <= sizes[owner] - GRAM
    return owner[inside], h[inside]


def gram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every distinct gram of at most 2048 texts, by one sort of packed words."""
    owner, h = grams(texts)
    packed = np.sort((owner.astype(np.uint64) << np.uint64(53)) | (h >> np.uint64(11)))
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed
    return (packed >> np.uint64(53)).astype(np.int64), packed & np.uint64((1 << 53) - 1)


def signatures(owner: np.ndarray, h: np.ndarray, n: int, rows: int, bands: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, bands) and bit sketches (n, BITS). Each of ``rows`` hash functions splits the grams over
    ``bands`` bins and keeps the least of each bin."""
    odd = np.random.default_rng(seed).integers(1, 2**63, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.zeros(n * bands, np.uint64)
    bits = np.zeros((n, 0), np.uint8)
    for r in range(rows):
        x = _mix(_mix(h * odd[r], 32) * _M[2], 29)
        cell = owner * bands + ((x >> np.uint64(32)) * np.uint64(bands) >> np.uint64(32)).astype(np.int64)
        least = np.full(n * bands, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, cell, (x & _LOW).astype(np.uint32))
        keys = _mix((keys ^ least) * _M[0], 29)
        take = math.ceil(BITS / rows)
        wide = least.reshape(n, bands)[:, :take] if bands >= take else np.tile(least.reshape(n, bands), (1, -(-take // bands)))[:, :take]
        bits = np.concatenate([bits, (_mix(wide.astype(np.uint64) * _M[3], 33) & np.uint64(1)).astype(np.uint8)], axis=1)
    keys = _mix((keys.reshape(n, bands) + np.arange(bands, dtype=np.uint64)) * _M[1], 30)
    return keys, bits[:, :BITS]


def words(bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches and set sizes as two words per text."""
    as_word = lambda b: (b.astype(np.uint64) << np.arange(b.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return as_word(bits[:, :64]), (as_word(bits[:, 64:]) << np.uint64(16)) | np.minimum(size, 0xFFFF).astype(np.uint64)


def cut_lists(keys: np.ndarray, text_id: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of entries whose lists are not cut (side 2), and of those of cut lists once for each list of
    two parts: only sides 0 and 1 are compared there, and the list of one part (side 2) as any other."""
    at = np.minimum(np.searchsorted(hot, keys), max(0, len(hot) - 1))
    cut = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
    rows, out, side = [np.flatnonzero(~cut)], [keys[~cut]], [np.full((~cut).sum(), 2, np.int8)]
    own = np.flatnonzero(cut)
    n = parts[at[own]] if len(own) else np.zeros(0, np.int64)
    p = (_mix(text_id[own].view(np.uint64) * _M[2], 32) % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)
    for other in range(int(n.max(initial=0))):
        use = other < n
        low, high = np.minimum(p[use], other), np.maximum(p[use], other)
        rows.append(own[use])
        out.append(_mix((keys[own[use]] ^ (low * 65_536 + high + 1).astype(np.uint64)) * _M[0], 31))
        side.append(np.where(p[use] == other, 2, (p[use] > other).astype(np.int64)).astype(np.int8))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(side)


def _listed(rows: int, bands: int, seed: int, hot: np.ndarray, parts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # texts of this task
        for batch in batches:
            ids = batch.column(0).to_pylist()
            fresh = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            if not fresh:
                continue
            texts = batch.column(1).take(pa.array(fresh)).to_pylist()
            for lo in range(0, len(fresh), 2000):
                part = texts[lo : lo + 2000]
                owner, h = gram_sets(part)
                keys, bits = signatures(owner, h, len(part), rows, bands, seed)
                low, high = words(bits, np.bincount(owner, minlength=len(part)))
                text_id = np.array([ids[i] for i in fresh[lo : lo + 2000]], np.int64)
                each = [np.repeat(x, bands) for x in (text_id, low.view(np.int64), high.view(np.int64))]
                row, key, side = cut_lists(keys.ravel(), each[0], hot, parts)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(x[row]) for x in each), pa.array(side)], names=["k", "t", "s", "u", "g"])

    return run


_LISTED = "k long, t long, s long, u long, g byte"


def crowded_lists(plain: DataFrame, rows: int, bands: int, seed: int, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(keys, parts) of the lists that seem longer than ``SPLIT``, judged from one key in ``SAMPLED``.

    It only decides how the work is dealt: pairs are the same whatever is cut. At most ``most`` lists are cut.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    some = plain.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("t", "x")
    counts = some.mapInArrow(_listed(rows, bands, seed, *none), _LISTED).groupBy("k").agg(F.count_distinct("t").alias("n")).where(F.col("n") * SAMPLED * 2 > SPLIT)
    found = sorted((r["k"] % 2**64, -(-r["n"] * SAMPLED // SPLIT)) for r in counts.orderBy(F.desc("n")).limit(most).collect())
    return np.array([k for k, _ in found], np.uint64), np.array([max(2, n) for _, n in found], np.int64)


def sketch_bound(threshold: float, recall: float) -> tuple[int, float]:
    """(bits that sketches must agree in to be compared, expected share of pairs exactly at the threshold lost by that).

    Bits agree with odds (1 + J) / 2; the share lost is at most a tenth of ``1 - recall``.
    """
    p, lost, least = (1 + threshold) / 2, 0.0, 0
    while lost + (more := math.comb(BITS, least) * p**least * (1 - p) ** (BITS - least)) <= (1 - recall) / 10:
        lost, least = lost + more, least + 1
    return least, lost


def _agreeing(low: np.ndarray, high: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    """Whether the sketches of entries i and j agree in at least ``least`` bits."""
    differ = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count((high[i] ^ high[j]) >> np.uint64(16))
    return BITS - differ >= least


def candidate_pairs(k: np.ndarray, t: np.ndarray, s: np.ndarray, u: np.ndarray, g: np.ndarray, threshold: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different texts in a common list, not of one side (0 or 1), visiting only the block of possible sizes."""
    size = (u & np.uint64(0xFFFF)).astype(np.int64)
    order = np.lexsort((t, size, k))
    k, t, s, u, g, size = k[order], t[order], s[order], u[order], g[order], size[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])]
    k, t, s, u, g, size = k[new], t[new], s[new], u[new], g[new], size[new]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    which = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(k)]))
    # where each entry's block ends: the last position of its list whose size is within reach
    top = np.minimum(np.floor(size / threshold + 1e-9), 0xFFFF).astype(np.int64)
    top = np.where(size == 0xFFFF, 0xFFFF, top)
    place = which * 0x10000 + size
    stop = np.searchsorted(place, which * 0x10000 + top, "right")
    todo = np.flatnonzero(stop - np.arange(len(k)) > 1)
    count = stop[todo] - todo - 1
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(count[lo:]), 2_000_000, "right")))
        i = np.repeat(todo[lo:hi], count[lo:hi])
        base = np.cumsum(count[lo:hi]) - count[lo:hi]
        j = i + 1 + np.arange(len(i)) - np.repeat(base, count[lo:hi])
        keep = _agreeing(s, u, i, j, least) & ((g[i] == 2) | (g[i] != g[j]))
        yield t[i[keep]], t[j[keep]]
        lo = hi


def _pairs(threshold: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input in order of k; whole lists are handed on as they fill a piece."""
        held: list[tuple[np.ndarray, ...]] = []

        def work(k, t, s, u, g):
            for a, b in candidate_pairs(k, t, s.view(np.uint64), u.view(np.uint64), g, threshold, least):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        rows = 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            rows += batch.num_rows
            if rows > 400_000 and held[0][0][0] != held[-1][0][-1]:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
                held = [tuple(c[cut:] for c in columns)]
                rows = len(columns[0]) - cut
                yield from work(*(c[:cut] for c in columns))
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def gram_set(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, set[str]] = ("", set())
        for batch in batches:
            keep, value = [], []
            for row, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if y != last[0]:
                    last = (y, gram_set(y))
                p, q = gram_set(x), last[1]
                common = len(p & q)
                j = common / max(1, len(p) + len(q) - common)
                if j >= threshold:
                    keep.append(row)
                    value.append(j)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(value, pa.float64())], names=["a", "b", "jaccard"]
            )

    return run


def banding(rows_of_table: int, threshold: float, recall: float) -> tuple[int, int]:
    """(hashes per band, bands): more hashes for larger tables, so lists stay short, and as many bands
    as give ``recall`` for pairs exactly at the threshold, after what their sketches lose."""
    rows = max(5, round(math.log(max(2, rows_of_table), 4)) - 3)
    listed = recall / (1 - sketch_bound(threshold, recall)[1])
    return rows, math.ceil(math.log(1 - listed) / math.log(1 - threshold**rows))


def similar_texts(
    df: DataFrame, key: str, text: str, threshold: float = 0.7, min_chars: int = 100, recall: float = 0.99, seed: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts that are compared in lower case, with white space runs as one blank.

    Members: one row (key, ``text_id``) per key and text of at least ``min_chars`` characters; equal texts
    have one ``text_id``, a 64-bit hash (two different texts of 10^9 share one with odds of 1 in 37). Links: ``a`` < ``b`` (text ids) and ``jaccard`` of the sets of
    4-character substrings, at least ``threshold``, one row per pair of different texts. ``recall`` is the
    least expected share of links found, at the threshold itself, by lists and sketches together; closer pairs
    are found more surely.
    Null and shorter texts and null keys are left out; repeated rows count once. Nothing is capped.
    """
    rows, bands = banding(df.count(), threshold, recall)
    plain = (
        df.where(F.col(key).isNotNull() & (F.length(text) >= min_chars))
        .select(F.col(key).alias("id"), squeeze(F.col(text)).alias("x"))
        .where(F.length("x") >= min_chars)
        .select("id", F.xxhash64("x").alias("t"), "x")
    )
    members = plain.select(F.col("id").alias(key), F.col("t").alias("text_id")).distinct()
    lists = plain.select("t", "x").mapInArrow(_listed(rows, bands, seed, *crowded_lists(plain, rows, bands, seed)), _LISTED)
    pairs = (
        lists.repartition("k").sortWithinPartitions("k").mapInArrow(_pairs(threshold, sketch_bound(threshold, recall)[0]), "a long, b long").distinct()
    )
    pairs = materialise(pairs, "candidates")
    texts = plain.select("t", "x").groupBy("t").agg(F.first("x").alias("x"))
    first = pairs.join(texts.select(F.col("t").alias("a"), F.col("x").alias("xa")), "a")
    both = first.join(texts.select(F.col("t").alias("b"), F.col("x").alias("xb")), "b")
    links = both.select("a", "b", "xa", "xb").mapInArrow(_verified(threshold), "a long, b long, jaccard double")
    return members, links


def expand_pairs(members: DataFrame, links: DataFrame, key: str, copies: int = 100) -> DataFrame:
    """(<key>_a, <key>_b), a < b: linked keys, copies included.

    Texts with at most ``copies`` copies are expanded in full. Of a text with more, its smallest key
    stands for it in the links, and every copy is paired with that key.
    """
    order = Window.partitionBy("text_id").orderBy(key)
    ranked = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= copies + 1)
    heads = ranked.groupBy("text_id").agg(F.sort_array(F.collect_list(key)).alias("ids"))
    heads = heads.select("text_id", F.when(F.size("ids") > copies, F.slice("ids", 1, 1)).otherwise(F.col("ids")).alias("ids"), (F.size("ids") > copies).alias("many"))
    left = heads.select(F.col("text_id").alias("a"), F.col("ids").alias("ia"))
    right = heads.select(F.col("text_id").alias("b"), F.col("ids").alias("ib"))
    across = links.join(left, "a").join(right, "b").select(F.explode("ia").alias("x"), "ib").select("x", F.explode("ib").alias("y"))
    several = heads.where("NOT many AND size(ids) > 1").select(F.posexplode("ids").alias("p", "x"), "ids")
    within = several.select("x", F.explode(F.slice("ids", F.col("p") + 2, F.lit(copies))).alias("y"))
    star = members.join(heads.where("many").select("text_id", F.col("ids")[0].alias("x")), "text_id").where(F.col(key) != F.col("x"))
    all_ = across.unionByName(within).unionByName(star.select("x", F.col(key).alias("y")))
    return all_.where("x != y").select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def all_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(<key>_a, <key>_b), a < b: every pair of keys with equal or linked texts, one row per pair.

    The copies of a text are dealt over blocks of about ``BLOCK`` keys, so a task's unit of work is a pair
    of blocks, however many copies a text has; the result does not depend on ``BLOCK``.
    """
    members = materialise(members.select("text_id", key), "members")
    # broadcast: at most one row per BLOCK members
    many = members.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    many = materialise(many.select("text_id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "blocks")
    count = F.coalesce("blocks", F.lit(1))
    dealt = members.join(F.broadcast(many), "text_id", "left").withColumn("block", F.pmod(F.xxhash64(key), count).cast("int"))
    blocks = dealt.groupBy("text_id", "block").agg(F.sort_array(F.collect_list(key)).alias("ids"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    sides = links.select("a", "b")
    for t, p in (("a", "p"), ("b", "q")):
        own = F.broadcast(many.select(F.col("text_id").alias(t), "blocks"))
        sides = sides.join(own, t, "left").select("*", numbers(F.col("blocks")).alias(p)).drop("blocks")
    same = many.select("text_id", "blocks", numbers(F.col("blocks")).alias("p")).select("*", numbers(F.col("blocks")).alias("q")).where("p < q")
    apart = sides.unionByName(same.select(F.col("text_id").alias("a"), F.col("text_id").alias("b"), "p", "q"))
    left = blocks.select(F.col("text_id").alias("a"), F.col("block").alias("p"), F.col("ids").alias("ia"))
    right = blocks.select(F.col("text_id").alias("b"), F.col("block").alias("q"), F.col("ids").alias("ib"))
    across = apart.join(left, ["a", "p"]).join(right, ["b", "q"]).select(F.explode("ia").alias("x"), "ib").select("x", F.explode("ib").alias("y"))
    several = blocks.where(F.size("ids") > 1).select(F.posexplode("ids").alias("i", "x"), "ids")
    within = several.select("x", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("y"))
    both = across.unionByName(within).where("x != y")
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def group_members(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, ``group_id``) for every member: texts linked directly or through others are a group, named by its smallest key."""
    groups = connected_groups(links, "a", "b", out="text_id").withColumn("text_id", F.col("text_id").cast("long"))
    own = materialise(members.join(groups, "text_id", "left").select(F.col(key).alias("v"), F.coalesce("group_id", F.col("text_id").cast("string")).alias("m")), "members")
    least = own.groupBy("m").agg(F.min("v").alias("top"))
    return relabelled(own, least).groupBy(F.col("v").alias(key)).agg(F.min("top").alias("group_id"))
