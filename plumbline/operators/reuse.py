"""The signals of reuse of every review within its place, from one shuffle of the texts.

A place is read whole by one task up to ``WHOLE`` reviews. Larger ones are cut into blocks of about that many: what
each block counts is summed up, and what enough of the place's reviews hold goes back to the blocks. Words, word pairs,
triples and sets of them are 64-bit hashes, so none of the tables between holds their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import CONFIG, TemplatedConfig
from plumbline.functions import lexicon
from plumbline.operators import temporal, texts
from plumbline.session import materialise

WHOLE = 20_000
_WORD = re.compile(texts.CYRILLIC_LATIN)
_END = re.compile(r"[.!?…]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SIGNALS = "phrase_reuse low_unique_detail peers structure uniformity temporal".split()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rnd(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _unit(x: np.ndarray) -> np.ndarray:
    return _rnd(np.clip(x, 0.0, 1.0), 4)


class _Codes(dict):
    """A word's hash, 0 for the words that are left out."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = 0 if word in _STOP else int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little") | 1
        self[word] = code
        return code


_STOP = frozenset(lexicon.STOP)
_CODES = _Codes()


class _Text:
    """The content words of lower-case texts: of each the text ``doc`` and the hash ``w``, in order; ``at2`` and ``g2``
    (``at3``, ``g3``): where pairs (triples) of adjacent words begin, and their hashes."""

    def __init__(self, values: list[str]):
        flat: list[str] = []
        sizes = []
        for v in values:
            found = _WORD.findall(v)
            flat += found
            sizes.append(len(found))
        w = np.fromiter(map(_CODES.__getitem__, flat), np.uint64, len(flat))
        doc, kept = np.repeat(np.arange(len(values)), sizes), w != 0
        self.n, self.doc, self.w = len(values), doc[kept], w[kept]
        pair = _mix(self.w[:-1] * _A + self.w[1:])
        self.at2 = np.flatnonzero(self.doc[:-1] == self.doc[1:])
        self.at3 = np.flatnonzero(self.doc[:-2] == self.doc[2:])
        self.g2, self.g3 = pair[self.at2], _mix(pair[self.at3] * _B + self.w[self.at3 + 2])


class _Held:
    """For each entry of ascending ``doc``: whether it is the first of its key in the text, a number for its key, how many texts hold the key."""

    def __init__(self, key: np.ndarray, doc: np.ndarray):
        order = np.argsort(key, kind="stable")
        k, d = key[order], doc[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = new.copy()
        first[1:] |= d[1:] != d[:-1]
        ids = np.cumsum(new) - 1
        self.keys, self.counts = k[new], np.bincount(ids, weights=first, minlength=0).astype(np.int64)
        self.first, self.id = np.empty(len(k), bool), np.empty(len(k), np.int64)
        self.first[order], self.id[order] = first, ids
        self.owners = self.counts[self.id]


def _phrase_reuse(x: _Text, hot2: np.ndarray, hot3: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(x.doc), bool)
    for at, k in ((x.at2[hot2], 2), (x.at3[hot3], 3)):
        for o in range(k):
            inside[at + o] = True
    tokens = np.bincount(x.doc, minlength=x.n)
    return _unit((np.bincount(x.doc[inside], minlength=x.n) / np.maximum(tokens, 1) - 0.5) / 0.25)


def _low_detail(x: _Text, first: np.ndarray, rare: np.ndarray) -> np.ndarray:
    words, few = np.bincount(x.doc[first], minlength=x.n), np.bincount(x.doc[first & rare], minlength=x.n)
    return np.where(words > 0, _unit((1 - few / np.maximum(words, 1)) / 0.5), 0.0)


def _set_hashes(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, hash) of the set of different keys of each text; ``doc`` ascending, a key once in a text."""
    size = np.bincount(doc, minlength=n)
    ends = np.cumsum(size)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(key + _B), dtype=np.uint64)])
    return size, _mix(run[ends] - run[ends - size] + size.astype(np.uint64))


def _similar_sets(owner: np.ndarray, element: np.ndarray, common: np.ndarray, copies: np.ndarray, t: float, chunk: int = 1_000_000) -> np.ndarray:
    """For each set the copies of the other sets with a Jaccard similarity of at least ``t``; see ``texts.bigram_peers``.

    ``owner``, ``element``, ``common``: entries of the sets, how common the element is; elements of different places differ.
    """
    near = np.zeros(len(copies), np.int64)
    order = np.lexsort((element, common, owner))
    s, e = owner[order], element[order]
    size = np.bincount(s, minlength=len(copies))
    start = np.cumsum(size) - size
    taken = np.arange(len(s)) - start[s] < (size - np.ceil(size * t - 1e-9) + 1)[s]
    ps, pe = s[taken], e[taken]
    by = np.lexsort((ps, pe))
    ps, pe = ps[by], pe[by]
    after = np.searchsorted(pe, pe, side="right") - np.arange(len(pe)) - 1  # later sets in the list of the same element
    many = int(element.max(initial=0)) + 1
    entries = np.sort(s * many + e)
    seen = [np.zeros(0, np.int64)]
    total, at = np.cumsum(after), 0
    while at < len(pe):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, side="right")))
        k = after[at:to]
        left = np.repeat(np.arange(at, to), k)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        a, b, at = ps[left], ps[right], to
        fit = np.minimum(size[a], size[b]) >= np.maximum(size[a], size[b]) * t
        seen.append(np.unique(a[fit] * len(copies) + b[fit]))
        if sum(map(len, seen)) > chunk:
            seen = [np.unique(np.concatenate(seen))]
    pairs = np.unique(np.concatenate(seen))
    for i in range(0, len(pairs), 50_000):
        a, b = np.divmod(pairs[i : i + 50_000], len(copies))
        n = size[a]
        which = np.repeat(np.arange(len(a)), n)
        ask = b[which] * many + e[start[a][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        hit = entries[np.minimum(np.searchsorted(entries, ask), len(entries) - 1)] == ask
        both = np.bincount(which[hit], minlength=len(a))
        ok = both >= t * (size[a] + size[b] - both)
        near += np.bincount(a[ok], weights=copies[b[ok]], minlength=len(near)).astype(np.int64) + np.bincount(b[ok], weights=copies[a[ok]], minlength=len(near)).astype(np.int64)
    return near


def _peers(x: _Text, place: np.ndarray, held: _Held, t: float) -> np.ndarray:
    doc, key = x.doc[x.at2][held.first], held.id[held.first]
    size, code = _set_hashes(doc, key.astype(np.uint64), x.n)  # keys differ by place
    some = np.flatnonzero(size)
    _, rep, of, copies = np.unique(code[some], return_index=True, return_inverse=True, return_counts=True)
    number = np.full(x.n, -1)
    number[some[rep]] = np.arange(len(rep))
    own = number[doc] >= 0
    near = _similar_sets(number[doc[own]], key[own], held.owners[held.first][own], copies, t)
    out = np.zeros(x.n, np.int64)
    out[some] = (copies - 1 + near)[of]
    return out


def _structure(shares: np.ndarray, place: np.ndarray, top: int = 5) -> np.ndarray:
    """See ``texts.structure_similarity``; ``shares``: the profiles in millionths, ``place`` ascending."""
    out = np.zeros(len(place))
    f6 = shares.astype(np.uint64)
    code = _mix(_mix(f6[:, 0] + (f6[:, 1] << np.uint64(20)) + (f6[:, 2] << np.uint64(40))) * _A + f6[:, 3] + (f6[:, 4] << np.uint64(20)) + (f6[:, 5] << np.uint64(40)))
    cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        _, rep, of, m = np.unique(code[a:b], return_index=True, return_inverse=True, return_counts=True)
        f = shares[a:b][rep] / 1e6
        add = lambda cols: reduce(np.add, cols)  # noqa: E731  the same order of sums as in the expression
        norm = np.sqrt(add([f[:, i] * f[:, i] for i in range(6)])) + 1e-9
        by = np.argsort(-m, kind="stable")
        mean = np.zeros(len(m))
        step = max(1, 2_000_000 // len(m))
        for i in range(0, len(m), step):
            own = np.arange(i, min(i + step, len(m)))
            sim = add([f[own, None, c] * f[None, by, c] for c in range(6)]) / (norm[own, None] * norm[None, by])
            count = np.repeat(m[None, by], len(own), axis=0) - (own[:, None] == by[None])
            sim[count == 0] = -1.0
            best = np.argsort(-sim, axis=1, kind="stable")[:, : top + 1]
            sim, count = np.take_along_axis(sim, best, 1), np.take_along_axis(count, best, 1)
            s, k = np.zeros(len(own)), np.zeros(len(own), np.int64)
            for c in range(best.shape[1]):
                use = np.minimum(count[:, c], top - k)
                s, k = s + sim[:, c] * use, k + use
            mean[own] = np.where(k > 0, s / np.maximum(k, 1), 0.0)
        out[a:b] = _unit((mean - 0.6) / 0.35)[of]
    return out


def _sentences(values: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(profiles in millionths, uniformity of the place) of each text; see ``texts.sentence_profiles`` and ``style_uniformity``."""
    words: list[int] = []
    sizes = []
    for v in values:
        own = [n for n in (len(s.split()) for s in _END.split(v)) if n]  # str.split parts at the characters of functions.text.SPACE
        words += own
        sizes.append(len(own))
    lengths, n = np.array(words, np.int64), np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(values)), n)
    bins = np.bincount(doc * 6 + np.minimum(lengths // 8, 5), minlength=6 * len(values)).reshape(-1, 6)
    shares = np.floor(bins / np.maximum(n, 1)[:, None] * 1e6 + 0.5).astype(np.int64)
    k, total, square = (np.bincount(place[doc], weights=v, minlength=place.max() + 1) for v in (np.ones(len(doc)), lengths, lengths**2))
    least = np.maximum(k, 1)
    cv = np.sqrt(np.maximum(least * square - total * total, 0)) / least / (total / least + 1e-9)
    return shares, np.where(k < 2, 0.0, _rnd(1 - np.clip((cv - 0.25) / 0.65, 0.0, 1.0), 4))[place]


def _temporal(day: np.ndarray, dated: np.ndarray, place: np.ndarray, reach: int = 7) -> np.ndarray:
    at = place[dated] * 10_000_000 + (day[dated] + 1_000_000)
    line = np.sort(at)
    out = np.ones(len(day))  # in full without a day, as the SQL has it
    out[dated] = np.minimum(np.searchsorted(line, at + reach, side="right") - np.searchsorted(line, at - reach) - 1, 5) / 5
    return out


def _of_places(t: pa.Table, cfg: TemplatedConfig) -> pa.Table:
    """The signals of whole places; rows of a place are together."""
    values, names = t.column("text").to_pylist(), t.column("place_id").to_pylist()
    place = np.cumsum([0] + [a != b for a, b in zip(names, names[1:])])
    x, salt = _Text(values), _mix(np.arange(place[-1] + 1).astype(np.uint64) * _A + _B)
    two, three, one = _Held(x.g2 ^ salt[place[x.doc[x.at2]]], x.doc[x.at2]), _Held(x.g3 ^ salt[place[x.doc[x.at3]]], x.doc[x.at3]), _Held(x.w ^ salt[place[x.doc]], x.doc)
    shares, style = _sentences(values, place)
    day = t.column("day").cast(pa.int32())
    found = [
        _phrase_reuse(x, two.owners > cfg.owners, three.owners > cfg.owners), _low_detail(x, one.first, one.owners - 1 <= cfg.rare), _peers(x, place, two, cfg.peer_similarity),
        _structure(shares, place), style, _temporal(day.fill_null(0).to_numpy().astype(np.int64), ~day.is_null().to_numpy(), place),
    ]
    return pa.table([*(t.column(c) for c in ("review_id", "place_id", "spec")), *map(pa.array, found)], names=["review_id", "place_id", "spec", *_SIGNALS])


def _whole(batches: Iterator[pa.RecordBatch], cfg: TemplatedConfig, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows ordered by place: places are taken together until there are enough rows, and never cut."""
    held: list[pa.Table] = []

    def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows:
            yield from _of_places(t, cfg).to_batches()

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(h.num_rows for h in held) >= rows:
            t = pa.concat_tables(held)
            last = t.column("place_id")[-1]
            cut = pc.index(t.column("place_id"), last).as_py()
            yield from finish(t.slice(0, cut))
            held = [t.slice(cut)]
    if held:
        yield from finish(pa.concat_tables(held))


def _tally(t: pa.Table) -> pa.Table:
    """(place_id, block, kind, key, n): how many texts of a block hold each word, pair and triple."""
    x = _Text(t.column("text").to_pylist())
    parts = [_Held(k, d) for k, d in ((x.w, x.doc), (x.g2, x.doc[x.at2]), (x.g3, x.doc[x.at3]))]
    keys, counts = (np.concatenate([getattr(p, c) for p in parts]) for c in ("keys", "counts"))
    kind = np.repeat(np.array([1, 2, 3], np.int8), [len(p.keys) for p in parts])
    same = [pa.array([t.column(c)[0].as_py()] * len(keys), t.schema.field(c).type) for c in ("place_id", "block")]
    return pa.table([*same, pa.array(kind), pa.array(keys.view(np.int64)), pa.array(counts)], names=["place_id", "block", "kind", "key", "n"])


def _of_block(t: pa.Table, common: pa.Table, cfg: TemplatedConfig) -> pa.Table:
    """The signals of a block's reviews by the counts of their place, with their sets of word pairs, the least common first."""
    x = _Text(t.column("text").to_pylist())
    kind, key, n = (common.column(c).to_numpy() for c in ("kind", "key", "n"))

    def owners(of: int, asked: np.ndarray) -> np.ndarray:
        """0 for those that are not common."""
        keys, counts = key[kind == of].view(np.uint64), n[kind == of]
        order = np.argsort(keys)
        keys, counts = np.append(keys[order], np.uint64(0)), np.append(counts[order], 0)
        at = np.searchsorted(keys[:-1], asked)
        return np.where(keys[at] == asked, counts[at], 0)

    own2, doc2 = owners(2, x.g2), x.doc[x.at2]
    first = _Held(x.g2, doc2).first
    detail = _low_detail(x, _Held(x.w, x.doc).first, owners(1, x.w) - 1 <= cfg.rare)
    reuse = _phrase_reuse(x, own2 > cfg.owners, owners(3, x.g3) > cfg.owners)
    doc, keys, own = doc2[first], x.g2[first], own2[first]
    size, code = _set_hashes(doc, keys, x.n)
    order = np.lexsort((keys, own, doc))
    sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys[order].view(np.int64)))
    return pa.table(
        [*(t.column(c) for c in ("review_id", "place_id", "day", "spec")), pa.array(reuse), pa.array(detail), pa.array(code.view(np.int64)), sets],
        names=["review_id", "place_id", "day", "spec", "phrase_reuse", "low_unique_detail", "h", "s"],
    )


def _crowded(rv: DataFrame, dealt: DataFrame, cfg: TemplatedConfig) -> DataFrame:
    """The signals of the reviews of places of more than one block. ``dealt``: (review_id, place_id, day, spec, text, block)."""
    counts = dealt.select("place_id", "block", "text").groupBy("place_id", "block").applyInArrow(_tally, "place_id string, block int, kind byte, key long, n long")
    summed = counts.groupBy("place_id", "kind", "key").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    common = summed.where(F.col("n") > F.when(F.col("kind") == 1, 1 + cfg.rare).otherwise(cfg.owners)).select("place_id", F.explode("blocks").alias("block"), "kind", "key", "n")
    kinds = "review_id string, place_id string, day date, spec double, phrase_reuse double, low_unique_detail double, h long, s array<long>"
    both = dealt.groupBy("place_id", "block").cogroup(common.groupBy("place_id", "block"))
    found = materialise(both.applyInArrow(lambda t, c: _of_block(t, c, cfg), kinds), "blocks")
    t = cfg.peer_similarity
    sets = found.where(F.size("s") > 0).groupBy("place_id", "h").agg(F.count(F.lit(1)).alias("m"), F.first("s").alias("s"))
    n = F.size("s")
    prefix = sets.select("place_id", "h", n.alias("n"), F.explode(F.slice("s", F.lit(1), (n - F.ceil(n * t) + 1).cast("int"))).alias("g"))
    near = texts.set_links(prefix, sets, t)
    peers = sets.select("place_id", "h", "m").join(near, ["place_id", "h"], "left").select("place_id", "h", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).cast("long").alias("peers"))
    days = temporal.peer_counts(rv.where("day IS NOT NULL").groupBy("place_id", "day").agg(F.count(F.lit(1)).alias("n"))).select("place_id", "day", (F.least(F.col("peers"), F.lit(5)) / 5).alias("temporal"))
    out = found.drop("s").join(peers, ["place_id", "h"], "left").join(texts.structure_similarity(rv), "review_id", "left")
    out = out.join(texts.style_uniformity(rv).select("place_id", "uniformity"), "place_id", "left").join(days, ["place_id", "day"], "left")
    return out.na.fill(1, ["temporal"]).na.fill(0, _SIGNALS).select("review_id", "place_id", "spec", *_SIGNALS)


def place_signals(rv: DataFrame, cfg: TemplatedConfig = CONFIG.templated, whole: int = WHOLE) -> DataFrame:
    """(review_id, place_id, spec, phrase_reuse, low_unique_detail, peers, structure, uniformity, temporal) of each review,
    as ``texts.phrase_reuse``, ``unique_detail``, ``bigram_peers``, ``structure_similarity``, ``style_uniformity`` and
    ``temporal.peer_counts`` have them; 0 where these have none, but a ``temporal`` of 1 (as in the SQL) without a
    day. Reviews without a place have that and a ``low_unique_detail`` among each other. ``rv`` needs ``spec``.
    """
    sizes = rv.where("place_id IS NOT NULL").groupBy("place_id").agg(F.ceil(F.count(F.lit(1)) / whole).cast("int").alias("blocks"))
    many = materialise(sizes.where("blocks > 1"), "crowded")  # at most a row for each ``whole`` reviews
    kinds = "review_id string, place_id string, spec double, phrase_reuse double, low_unique_detail double, peers long, structure double, uniformity double, temporal double"
    rows = rv.select("review_id", "place_id", "day", "spec", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    usual = rows.where("place_id IS NOT NULL").join(F.broadcast(many), "place_id", "left_anti")
    out = usual.repartition("place_id").sortWithinPartitions("place_id").mapInArrow(lambda it: _whole(it, cfg), kinds)
    nowhere = rv.where("place_id IS NULL")
    detail = texts.unique_detail(nowhere.withColumn("place_id", F.lit("")), cfg).select("review_id", "low_unique_detail")
    nothing = [F.lit(int(s == "temporal")).cast("long" if s == "peers" else "double").alias(s) for s in _SIGNALS if s != "low_unique_detail"]
    nowhere = nowhere.join(detail, "review_id", "left").select("review_id", "place_id", "spec", F.coalesce("low_unique_detail", F.lit(0.0)).alias("low_unique_detail"), *nothing)
    out = out.unionByName(nowhere)
    if many.isEmpty():
        return out
    dealt = rows.join(F.broadcast(many), "place_id").withColumn("block", F.pmod(F.xxhash64("review_id"), F.col("blocks")).cast("int")).drop("blocks")
    return out.unionByName(_crowded(rv.join(F.broadcast(many.select("place_id")), "place_id", "left_semi"), dealt, cfg))
