"""Families, topics and corpus rules against brute force and known cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import corpus, families, report, summary, topics


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdя ", max_size=40), st.text("abcdя ", max_size=40))
def test_common_subsequence(a, b):
    assert families.common_subsequence(a, b) == _lcs(a, b)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=12))
def test_bounds_lose_no_pair(texts):
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if 2 * _lcs(a, b) / (len(a) + len(b)) >= 0.85}
    assert {(i, j) for i, j, _ in families.close_texts(texts, texts)} == want


def _brute(rows, vectors):
    """families of {place: [(id, text)]} by the plain rules"""
    out = {}
    for place, own in rows.items():
        text = {i: " ".join((t or "").lower().split()) for i, t in own}
        exact = {i for i in text if sum(text[i] == t for t in text.values()) > 1}
        edges = {}
        ids = sorted(text)
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                found = []
                if not (a in exact and b in exact) and (text[a] or text[b]):
                    s = 2 * _lcs(text[a], text[b]) / (len(text[a]) + len(text[b]))
                    found += [(s, 1, "near")] if s >= 0.9 else [(s, 1, "fuzzy")] if s >= 0.85 else []
                if vectors.get(place):
                    u, v = vectors[place][a], vectors[place][b]
                    s = float(u @ v / np.linalg.norm(u) / np.linalg.norm(v))
                    found += [(s, 0, "semantic")] if s >= 0.88 else []
                if text[a] == text[b]:
                    edges[a, b] = (1.0, "exact")
                elif found:
                    edges[a, b] = (max(found)[0], max(found)[2])
        group = {i: {i} for i in ids}
        for a, b in edges:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
        for g in {id(x): x for x in group.values()}.values():
            if len(g) > 1:
                own_edges = [e for (a, _), e in edges.items() if a in g]
                kinds = [k for _, k in own_edges]
                out[min(g)] = (len(g), len(g & exact), *[kinds.count(k) for k in ("near", "fuzzy", "semantic")], sum(s for s, _ in own_edges) / len(own_edges))
    return out


@pytest.mark.parametrize("few", [2000, 0])
def test_families_equal_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(families, "FEW", few)
    monkeypatch.setattr(families, "BLOCK", 7)
    rng = random.Random(3)
    words = ["soup", "table", "waiter", "garden", "parking", "music", "dessert", "window", "kitchen", "terrace", "coffee", "bread"]
    rows, vectors = {}, {}
    for place in ("p", "q", "alone"):
        base = [" ".join(rng.choices(words, k=9)) for _ in range(6)]
        own = []
        for i in range(1 if place == "alone" else 28):
            t = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice("xyz ") + t[at + rng.choice([0, 1]) :]
            own.append((f"{place}{i:02d}", rng.choice([t, t.upper(), f" {t} "])))
        rows[place] = own
    rows["p"] += [("pn1", None), ("pn2", "  ")]
    axis = np.random.default_rng(2).standard_normal((4, 12))
    vectors["q"] = {i: axis[rng.randrange(4)] + 0.2 * np.random.default_rng(int(i[1:])).standard_normal(12) for i, _ in rows["q"]}
    rv = spark.createDataFrame([(p, i, t) for p, own in rows.items() for i, t in own] + [(None, "lost", "x")], "place_id string, review_id string, text string")
    known = spark.createDataFrame([(i, v.tolist()) for i, v in vectors["q"].items()] + [("p00", [1.0] * 12)], "review_id string, embedding array<double>")
    members, rolled = families.duplicate_families(rv, topics.complete_places(rv, known))
    got = {r["family"]: tuple(r)[1:] for r in rolled.collect()}
    want = _brute(rows, vectors)
    if few:
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k][:5] == v[:5] and got[k][5] == pytest.approx(v[5], abs=2e-4)
        sizes = {r["family"]: r["n"] for r in members.groupBy("family").agg(F.count("*").alias("n")).collect()}
        assert sizes == {k: v[0] for k, v in want.items()}
    else:  # candidates by bands of minimum hashes: those that share few 4-character pieces may be missed
        assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())
    assert families.duplicate_families(rv.limit(0))[1].count() == 0


def test_topic_clusters_find_groups_and_noise(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(3, 8)
    x = np.concatenate([c + 0.05 * rng.standard_normal((12, 8)) for c in centres] + [rng.standard_normal((2, 8))])
    labels = topics.density_clusters(topics.reduced(x))
    assert len({*labels[:12]}) == len({*labels[12:24]}) == len({*labels[24:36]}) == 1 and len({labels[0], labels[12], labels[24]} - {-1}) == 3
    assert (topics.density_clusters(np.zeros((4, 2))) == -1).all()
    ids = [f"r{i:02d}" for i in range(len(x))]
    rows = [("p", i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [("tiny", "t1", [1.0] * 8), ("tiny", "t2", [1.0] * 8), ("half", "h1", [1.0] * 8), ("half", "h2", None)]
    rv = spark.createDataFrame([(p, i) for p, i, _ in rows], "place_id string, review_id string")
    vectors = spark.createDataFrame([(i, v) for _, i, v in rows if v], "review_id string, embedding array<double>")
    complete = topics.complete_places(rv, vectors)
    assert {r[0] for r in complete.select("place_id").distinct().collect()} == {"p", "tiny"}
    got = topics.topic_clusters(complete).collect()
    assert {r["place_id"] for r in got} == {"p"} and len({r["cluster_id"] for r in got}) == 3 and max(r["similarity"] for r in got) > 0.9
    assert sum(r["rank"] == 1 for r in got) == 3
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = ((u @ u.T) >= 0.88).sum(axis=1) - 1
    assert {r["review_id"]: r["peers"] for r in topics.semantic_peers(complete, block=10).where("review_id like 'r%'").collect()} == dict(zip(ids, near.tolist(), strict=True))


def test_addresses_durations_and_percents(spark):
    rows = ["1 Main St, Burlington, VT 05401", "12 Oak Ave, VT 05401-1234", "VT 05401", "Burlington, Vermont", "5 x, 7th Row, NH 03301", "", None]
    df = spark.createDataFrame([(a,) for a in rows], "a string")
    city, region = corpus.city_and_region(F.col("a"))
    assert [tuple(r) for r in df.select(city, region).collect()] == [("Burlington", "VT"), (None, "VT"), (None, "VT"), (None, None), (None, "NH"), (None, None), (None, None)]
    days = spark.createDataFrame([(d,) for d in (None, 0, 1, 12, 60, 365, 400)], "d int")
    assert [r[0] for r in days.select(corpus.human_duration(F.col("d"))).collect()] == ["no data", "no data", "1 day", "~12 days", "~2 months", "~1 years", "~1.1 years"]
    assert days.limit(1).select(corpus.percent(F.lit(0.1234)), corpus.rating_mix([F.lit(0)] * 5)).first()[:] == ("12.3%", "no ratings on record")


def test_partitions_and_agreement_on_empty_tables(spark):
    empty = spark.createDataFrame([], "review_id string, group string")
    assert report.group_agreement(empty, empty).first()["recovered_share"] is None
    assert report.same_ids(empty, empty).first()["equal"]
    pairs = spark.createDataFrame([("a", "e"), ("b", "e"), ("c", "f")], "review_id string, group string")
    assert report.group_agreement(pairs, pairs).first()["matched_predicted"] == 2
    fam = spark.createDataFrame([("a", "a", 2, 1.0), ("b", "a", 2, 1.0)], "review_id string, family string, family_size int, avg_similarity double")
    rv = spark.createDataFrame([("a", 5, None), ("b", None, None)], "review_id string, rating int, day date")
    row = summary.family_context(rv, fam).first()
    assert row["concentration"] == 1.0 and row["identical_share"] == 1.0 and row["days"] == 0
