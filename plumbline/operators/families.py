"""Families of duplicate reviews of a place: equal, near, fuzzy and semantically close texts.

Equal texts are one class with a count, so copies are never compared. Classes of a place are compared pairwise in
blocks while they are few; in a place with more, those are compared that share a band of minimum hashes of their
4-character sets. The similarity is 2 x longest common subsequence / both lengths; bounds that lose nothing, from
the lengths and from the common 2-character pieces, decide first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.num import rnd
from plumbline.functions.text import squeeze
from plumbline.operators.graph import connected_components
from plumbline.session import materialise

#: Least similarity of ``near`` and of ``fuzzy`` links, and least cosine of ``semantic`` ones.
NEAR, FUZZY, SEMANTIC = 0.90, 0.85, 0.88
#: Classes of a place up to which all are compared; classes in a block.
FEW, BLOCK = 2000, 500
ROWS, BANDS = 6, 42
_LINK = "place_id string, a string, b string, score double"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, 1 bit a character of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def similarity(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def _pieces(texts: list[str]) -> np.ndarray:
    """Counts of 2-character pieces by a hash of 256 values; different pieces that share a value only raise the bound."""
    out = np.zeros((len(texts), 256), np.int16)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(c) > 1:
            out[i] = np.minimum(np.bincount(((c[:-1] * np.uint64(31) + c[1:]) % np.uint64(251)).astype(np.int64), minlength=256), 32_000)
    return out


def close_texts(left: list[str], right: list[str], least: float = FUZZY) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of all pairs with at least ``least``."""
    la, lb = (np.array([len(t) for t in x], np.int64) for x in (left, right))
    pa_, pb = _pieces(left), _pieces(right)
    found = []
    for i, text in enumerate(left):
        total = la[i] + lb
        need = np.ceil(least * total / 2 - 1e-9)  # of the common subsequence
        ok = np.minimum(la[i], lb) >= need
        at = np.flatnonzero(ok)
        common = np.minimum(pa_[i], pb[at]).sum(axis=1, dtype=np.int64)
        at = at[common >= np.maximum(la[i], lb[at]) - 1 - 2 * (total[at] - 2 * need[at])]
        for j in at.tolist():
            s = similarity(text, right[j])
            if s >= least:
                found.append((i, j, s))
    return found


def text_classes(rv: DataFrame) -> DataFrame:
    """(place_id, class, text, members): the different texts of each place, named by their smallest review; null and blank
    texts are one."""
    t = F.coalesce(squeeze(F.col("text")), F.lit(""))
    return rv.where("place_id IS NOT NULL").groupBy("place_id", t.alias("text")).agg(F.min("review_id").alias("class"), F.count(F.lit(1)).alias("members"))


def _bands(batches):
    odd = np.random.default_rng(17).integers(1, 2**63, size=ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        rows: list[tuple[int, list[int]]] = []
        for i, t in enumerate(batch.column(2).to_pylist()):
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            if len(c) >= 4:
                h = np.unique(((c[:-3] * odd[0] + c[1:-2]) * odd[1] + c[2:-1]) * odd[2] + c[3:])
                least = np.array([((h ^ (h >> np.uint64(29))) * o >> np.uint64(11)).min() for o in odd])
                keys = least.reshape(BANDS, ROWS)[:, 0]
                for r in range(1, ROWS):
                    keys = (keys ^ least.reshape(BANDS, ROWS)[:, r]) * odd[r]
                rows.append((i, ((keys + np.arange(BANDS, dtype=np.uint64)) * odd[7]).view(np.int64).tolist()))
        at = [i for i, keys in rows for _ in keys]
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([k for _, keys in rows for k in keys], pa.int64())], names=["place_id", "class", "k"])


def text_links(classes: DataFrame, least: float = FUZZY) -> DataFrame:
    """(place_id, a, b, score), a < b: similar classes of a place that are not both repeated texts."""
    sizes = classes.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    sized = classes.where("text != ''").join(sizes, "place_id")
    few = sized.where(F.col("n") <= FEW).withColumn("p", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    meet = few.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)).alias("o"))
    cells = meet.select("place_id", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "class", "text", (F.col("members") > 1).alias("many"), "p")

    def block(t: pa.Table) -> pa.Table:
        r = sorted(t.select(["class", "text", "many", "p"]).to_pylist(), key=lambda x: x["class"])
        place, i, j = (t.column(c)[0].as_py() for c in ("place_id", "i", "j"))
        left, right = [x for x in r if x["p"] == i], [x for x in r if x["p"] == j]
        out = []
        for a, b, s in close_texts([x["text"] for x in left], [x["text"] for x in right], least):
            x, y = left[a], right[b]
            if not (x["many"] and y["many"]) and (i != j or x["class"] < y["class"]):
                out.append((*sorted((x["class"], y["class"])), s))
        return pa.table([pa.array([place] * len(out), pa.string()), *(pa.array([o[c] for o in out], k) for c, k in enumerate((pa.string(), pa.string(), pa.float64())))], names=["place_id", "a", "b", "score"])

    listed = sized.where(F.col("n") > FEW)
    bands = listed.select("place_id", "class", "text").mapInArrow(_bands, "place_id string, class string, k long")
    pairs = bands.alias("x").join(bands.alias("y"), ["place_id", "k"]).where("x.class < y.class").select("place_id", F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    one = listed.select("place_id", "class", "text", (F.col("members") > 1).alias("many"))
    side = lambda n: one.select("place_id", F.col("class").alias(n), F.col("text").alias("t" + n), F.col("many").alias("m" + n))
    both = pairs.join(side("a"), ["place_id", "a"]).join(side("b"), ["place_id", "b"]).where("NOT (ma AND mb)").select("place_id", "a", "b", "ta", "tb")

    def verify(batches):
        for batch in batches:
            s = [similarity(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s, pa.float64())], names=["place_id", "a", "b", "score"])

    return cells.groupBy("place_id", "i", "j").applyInArrow(block, _LINK).union(both.mapInArrow(verify, _LINK).where(F.col("score") >= least))


def semantic_links(complete: DataFrame, least: float = SEMANTIC, block: int = 1000) -> DataFrame:
    """(place_id, a, b, score), a < b: review pairs of ``topics.complete_places`` with a cosine of at least ``least``, in blocks."""
    size = complete.groupBy("place_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"))
    dealt = complete.join(size, "place_id").withColumn("p", F.pmod(F.xxhash64("review_id"), F.col("k")).cast("int"))
    meet = dealt.select("place_id", "review_id", "embedding", "p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    cells = meet.select("place_id", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "review_id", "embedding", "p")

    def run(t: pa.Table) -> pa.Table:
        place, i, j = (t.column(c)[0].as_py() for c in ("place_id", "i", "j"))
        ids, p = np.array(t.column("review_id").to_pylist(), object), t.column("p").to_numpy()
        x = np.array(t.column("embedding").to_pylist(), float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm < 1e-9, 1.0, norm)
        left, right = np.flatnonzero(p == i), np.flatnonzero(p == j)
        cos = x[left] @ x[right].T
        u, v = np.nonzero(cos >= least)
        rows = [(*sorted((ids[left[a]], ids[right[b]])), float(cos[a, b])) for a, b in zip(u, v, strict=True) if (ids[left[a]] < ids[right[b]] if i == j else True)]
        return pa.table([pa.array([place] * len(rows), pa.string()), *(pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.string(), pa.string(), pa.float64())))], names=["place_id", "a", "b", "score"])

    return cells.groupBy("place_id", "i", "j").applyInArrow(run, _LINK)


def duplicate_families(rv: DataFrame, complete: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, families).

    Members: (place_id, family, review_id, class, exact) of every review in a family of at least two; ``family`` is the
    smallest review of the family, ``exact`` whether the review's text occurs again in the place. Families: members,
    ``exact_count`` (members whose text is repeated), numbers of near, fuzzy and semantic links and ``avg_similarity``
    over all links, copies counted as if each pair were listed. A pair of equal texts is an exact link of 1, whatever else
    it is; of a text and a semantic link the higher score counts, the text link at a tie. ``complete``: vectors of whole places
    (``topics.complete_places``); without it there are no semantic links. Null places are left out.
    """
    classes = materialise(text_classes(rv), "classes")
    links = materialise(text_links(classes).withColumn("kind", F.when(F.col("score") >= NEAR, "near").otherwise("fuzzy")), "links")
    keyed = rv.where("place_id IS NOT NULL").select("place_id", "review_id", F.coalesce(squeeze(F.col("text")), F.lit("")).alias("text"))
    own = materialise(keyed.join(classes, ["place_id", "text"]).select("place_id", "review_id", "class", "members"), "own")
    size = classes.select(F.col("class"), F.col("members").alias("m"))
    weighted = links.join(size.withColumnsRenamed({"class": "a", "m": "ma"}), "a").join(size.withColumnsRenamed({"class": "b", "m": "mb"}), "b")
    # (a, b, kind, pairs, score): links of classes with the pairs of reviews that they stand for
    counted = weighted.select("a", "b", "kind", (F.col("ma") * F.col("mb")).alias("pairs"), "score")
    if complete is not None:
        c = own.select("review_id", "class")
        pairs = semantic_links(complete).join(c.withColumnsRenamed({"review_id": "a", "class": "ca"}), "a").join(c.withColumnsRenamed({"review_id": "b", "class": "cb"}), "b").where("ca != cb")
        pairs = pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), F.col("score").alias("s"))
        beside = pairs.join(links.select("a", "b", "score", "kind"), ["a", "b"], "left").where("score IS NULL OR s > score")
        counted = counted.union(beside.select("a", "b", F.lit("semantic"), F.lit(1).cast("long"), F.col("s")))
        # a semantic link that wins takes its pair from the text link
        counted = counted.union(beside.where("score IS NOT NULL").select("a", "b", "kind", F.lit(-1).cast("long"), "score"))
    counted = materialise(counted, "counted")
    joined = connected_components(counted, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("family"))
    family = classes.join(joined, "class", "left").select("place_id", "class", "members", F.coalesce("family", "class").alias("family"))
    sizes = family.groupBy("family").agg(F.sum("members").alias("size"), F.sum(F.when(F.col("members") > 1, F.col("members")).otherwise(0)).alias("exact_count"),
                                         F.sum(F.col("members") * (F.col("members") - 1) / 2).alias("exact_pairs")).where("size >= 2")
    of = counted.join(family.select(F.col("class").alias("a"), "family"), "a")
    n = lambda k: F.sum(F.when(F.col("kind") == k, F.col("pairs")).otherwise(0)).alias(f"{k}_links")
    per = of.groupBy("family").agg(n("near"), n("fuzzy"), n("semantic"), F.sum("pairs").alias("pairs"), F.sum(F.col("pairs") * F.col("score")).alias("sum"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = (z("sum") + F.col("exact_pairs")) / (z("pairs") + F.col("exact_pairs"))
    rolled = sizes.join(per, "family", "left").select(
        "family", F.col("size").alias("members"), "exact_count", *[z(f"{k}_links").alias(f"{k}_links") for k in ("near", "fuzzy", "semantic")], rnd(mean, 4).alias("avg_similarity")
    )
    members = own.join(family.select("class", "family"), "class").join(sizes.select("family"), "family", "left_semi")
    return members.select("place_id", "family", "review_id", "class", (F.col("members") > 1).alias("exact")), rolled
