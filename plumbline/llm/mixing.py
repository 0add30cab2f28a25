"""Mixing sources to target weights.

The total is the largest at which every source can hold its share within its cap. A source's share of it
divided by the source's tokens gives the expected number of copies of each of its documents. The whole part
is certain; the fraction is rounded by pivotal sampling: a document and its partner exchange token mass at
random, one way or the other with the odds that keep both expectations, until the document is whole. Each task
reduces its documents to at most one fractional one, a small one; these residuals are combined in a tree, so
the tokens of a source miss their expectation by less than one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import source_key
from plumbline.session import materialise

FAN_IN = 64
_EPS = 1e-9


def pivotal(share: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds ``share`` (within 0..1), keeping sum(share * weight), to one fraction at most.

    The largest document comes first; its partner is the rest, all smaller ones together: mass moves between the
    two until the document is integral, spread over the rest in proportion to what each can give or take. So the
    large ones are settled while others can still make up for them, and what stays fractional at the end is small.
    A document for which the rest could make up only one way, larger than what the source may give for example,
    goes that way.
    """
    p = np.where(share < _EPS, 0.0, np.where(share > 1 - _EPS, 1.0, share))
    order = np.argsort(-weight, kind="stable")
    order = order[(p[order] > 0) & (p[order] < 1)]
    w, q = weight[order].astype(float), p[order]
    after_w = np.append(np.cumsum(w[::-1])[::-1], 0.0)[1:].tolist()  # of all later documents
    after_m = np.append(np.cumsum((w * q)[::-1])[::-1], 0.0)[1:].tolist()
    luck = rng.random(len(order)).tolist()
    out = np.empty(len(order))
    scale, shift = 1.0, 0.0  # what became of the fractions of the rest: scale * share + shift
    for i, (wi, qi) in enumerate(zip(w.tolist(), q.tolist(), strict=True)):
        now = min(1.0, max(0.0, scale * qi + shift))
        held = max(0.0, scale * after_m[i] + shift * after_w[i])
        room = max(0.0, after_w[i] - held)
        up, down = min(wi * (1 - now), held), min(wi * now, room)
        whole_up, whole_down = up == wi * (1 - now), down == wi * now
        rise = luck[i] * (up + down) < down if whole_up == whole_down else whole_up
        if rise and up > 0:
            now += up / wi
            keep = 1 - up / held
            scale, shift = scale * keep, shift * keep
        elif not rise and down > 0:
            now -= down / wi
            keep = 1 - down / room
            scale, shift = scale * keep, shift * keep + 1 - keep
        out[i] = round(now) if now < _EPS or now > 1 - _EPS else now
    p[order] = out
    return p


def _rounder(seed: int, last: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("tokens", "ascending")])
        w = t.column("tokens").to_numpy().astype(float)
        rng = np.random.default_rng([seed, *(t.column("source")[0].as_py() or "").encode(), *str(t.column("id")[0].as_py()).encode()])
        p = pivotal(t.column("fraction").to_numpy(), w, rng)
        open_ = (p > 0) & (p < 1)
        if last:
            p = np.where(open_, (rng.random(len(p)) < p).astype(float), p)
            open_[:] = False
        copies = t.column("copies").to_numpy() + np.where(open_, 0, p).astype(np.int64)
        return pa.table({
            "id": t.column("id"), "source": t.column("source"), "tokens": t.column("tokens"), "salt": t.column("salt"),
            "copies": pa.array(copies, pa.int64()), "fraction": pa.array(np.where(open_, p, 0.0)),
        })

    return run


def shared_total(held: dict[str, int], share: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total, at most the tokens of all sources, of which each source that has any can give its share."""
    there = [s for s in share if held.get(s, 0) > 0 and share[s] > 0]
    listed = sum(share[s] for s in there) / (sum(share.values()) or 1.0)
    return min([float(sum(held.values())), *(held[s] * repeats[s] * listed / share[s] for s in there)]) if there else 0.0


def mix(
    documents: DataFrame, targets: DataFrame, key: str, size: str, source: str = "source", seed: int = 7, rows_per_task: int = 50_000, hold: str = "shares"
) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    ``targets``: (source, target_share, max_repeats); a source listed twice is an error. All tokens are those of
    all documents of listed sources, compared trimmed and in lower case; a source is ``capped`` whose repeats do
    not reach its share of them. ``hold``: "shares" takes the largest total at which every source holds its
    share, those without tokens left aside; "tokens" takes all tokens as the total, so capped sources fall
    short and others have more than their share. Selection: one row per document of a listed source with
    ``copies`` (0..max_repeats); documents of size 0 or null get 0 copies, those of other sources and of a
    null source are left out. Report: one row per target with ``tokens``, ``target_tokens`` (of the total
    taken), ``expected_copies``, ``capped``, ``actual_tokens`` and ``actual_share``; a target without
    documents has 0 tokens. Documents are grouped by source and hash into groups of at most about
    ``rows_per_task``, so a source that holds most rows is spread.
    """
    if hold not in ("shares", "tokens"):
        raise ValueError(hold)
    want = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    rows = want.collect()  # the configuration
    if len({r["source"] for r in rows}) < len(rows):
        raise ValueError("a source is listed twice")
    listed = (
        documents.select(F.col(key).alias("id"), source_key(F.col(source)).alias("source"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("tokens"))
        .where(F.col("source").isin([r["source"] for r in rows]))
    )
    listed = materialise(listed, "mix")
    sums = listed.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    salts = max(1, -(-sum(r["n"] for r in sums) // rows_per_task))
    held = {r["source"]: r["t"] for r in sums}
    all_tokens = float(sum(held.values()))
    total = all_tokens if hold == "tokens" else shared_total(held, {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows})
    spread = 1.0
    if hold == "shares":  # the shares of sources without tokens go to the others in proportion
        spread = sum(r["target_share"] for r in rows) / (sum(r["target_share"] for r in rows if held.get(r["source"], 0)) or 1.0)
    plan = []
    for r in rows:
        own, aim = held.get(r["source"], 0), r["target_share"] * total * spread
        capped = own * r["max_repeats"] < r["target_share"] * all_tokens
        plan.append((r["source"], own, aim, min(float(r["max_repeats"]), aim / own) if own else 0.0, capped, r["target_share"], r["max_repeats"]))
    spark = documents.sparkSession
    rates = spark.createDataFrame(plan, "source string, tokens long, target_tokens double, expected_copies double, capped boolean, target_share double, max_repeats int")
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in plan for x in (p[0], p[3])]), F.col("source")), F.lit(0.0)) if plan else F.lit(0.0)
    rate = F.when(F.col("tokens") > 0, rate).otherwise(0.0)
    level = listed.select(
        "id", "source", "tokens", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), F.floor(rate).cast("long").alias("copies"), (rate - F.floor(rate)).alias("fraction")
    )
    schema = "id " + documents.schema[key].dataType.simpleString() + ", source string, tokens long, salt long, copies long, fraction double"
    done: list[DataFrame] = []
    groups = salts
    while True:
        last = groups == 1
        level = materialise(level.groupBy("source", "salt").applyInArrow(_rounder(seed + len(done), last), schema), "rounded")
        done.append(level if last else level.where("fraction = 0"))
        if last:
            break
        groups = -(-groups // FAN_IN)
        level = level.where("fraction > 0").withColumn("salt", F.pmod(F.col("salt"), F.lit(groups)))
    selection = done[0]
    for x in done[1:]:
        selection = selection.union(x)
    selection = selection.select(F.col("id").alias(key), "source", F.col("tokens").alias(size), F.col("copies").cast("int").alias("copies"))
    actual = selection.groupBy("source").agg(F.sum(F.col(size) * F.col("copies")).alias("actual_tokens"), F.sum("copies").alias("copies"))
    whole = actual.agg(F.sum("actual_tokens").alias("all_tokens"))
    report = (
        rates.join(actual, "source", "left")
        .join(F.broadcast(whole))  # one row
        .withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
        .withColumn("actual_share", F.col("actual_tokens") / F.nullif(F.col("all_tokens"), F.lit(0)))
        .drop("all_tokens")
    )
    return selection, report
