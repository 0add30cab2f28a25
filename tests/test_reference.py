"""Every query with SQL against DuckDB, and scenarios with known results."""

import collections
import datetime as dt
import glob
import math
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.operators import graph, keywords, sampling, scoring, temporal, texts, validation

DATA = "/root/testdata/sf0.001"
CHEAP = (
    "place_rollup place_meta_best store_counts filtered_reviews data_quality rating_distribution category_quartiles place_ranking burst_events temporal_gap_signal"
    " temporal_peer_signal reviewer_metrics category_experience local_familiarity specificity content_token_counts phrase_reuse unique_detail style_uniformity"
    " exact_duplicate_groups family_components cleaned_labels confusion_sweep specificity_spearman label_coverage largest_remainder cumulative_pick dataset_fingerprint"
    " cache_misses mean_cosine p1_found p1_by_type p3_found p3_rows p4_found p6_found review_evidence place_phrases family_context single_categories reviewer_periods kcore_reviews centre_cosines"
).split()


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def _place(spark, counts):
    rows = [(f"r{d}-{i}", "p", day, rating) for d, (day, ratings) in enumerate(counts) for i, rating in enumerate(ratings)]
    return temporal.daily_counts(spark.createDataFrame(rows, "review_id string, place_id string, day date, rating int"))


def test_a_day_far_above_a_steady_place_is_a_high_burst(spark):
    start = dt.date(2026, 1, 1)
    days = [(start + dt.timedelta(days=k), [5, 5, 4, 3, 1]) for k in range(60)] + [(start + dt.timedelta(days=70), [5] * 46 + [4] * 4)]
    daily = _place(spark, days)
    events = temporal.burst_events(daily).collect()
    assert [(e["day"], e["severity"], e["r5"], e["r4"]) for e in events] == [(start + dt.timedelta(days=70), "HIGH", 46, 4)] and events[0]["score"] >= 60
    shift = temporal.rating_shifts(daily, temporal.burst_events(daily)).collect()
    assert shift[0]["severity"] == "HIGH" and shift[0]["top_share"] > 0.9


def test_steady_and_sparse_places_have_no_burst(spark):
    start = dt.date(2026, 1, 1)
    assert temporal.burst_events(_place(spark, [(start + dt.timedelta(days=k), [4] * 5) for k in range(60)])).count() == 0
    assert temporal.burst_events(_place(spark, [(start, [4]), (start + dt.timedelta(days=50), [5] * 3)])).count() == 0


def test_components_core_and_samples(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "q")], "u string, v string")
    assert {tuple(r) for r in graph.connected_components(e, "u", "v").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graph.connected_components(e.limit(0), "u", "v").count() == 0
    rows = [(f"p{i}", f"u{j}") for i in range(2) for j in range(8) for _ in range(2)] + [("tiny", "u0"), ("p0", "once")]
    kept = graph.bipartite_core(spark.createDataFrame(rows, "p string, u string"), "p", "u", 10, 3, 2)
    assert kept.count() == 32
    df = spark.createDataFrame([(f"r{i}", "ab"[i % 2]) for i in range(100)], "id string, g string")
    one, two = ({r["id"] for r in sampling.simple_sample(x, "id", 10, 3).collect()} for x in (df, df.orderBy("g")))
    assert one == two and len(one) == 10
    assert sampling.proportional_sample(df, "id", "g", 11, 3).count() == 11


def test_specificity_and_rank_correlation(spark):
    rows = [("a", None), ("b", "   "), ("c", "Всё понравилось"), ("d", "Ждали столик 40 минут, официант потом принёс холодный борщ без извинений " * 4)]
    got = {r["review_id"]: r["specificity"] for r in texts.specificity_scores(spark.createDataFrame(rows, "review_id string, text string")).collect()}
    assert got["a"] == got["b"] == 0 and got["c"] < 30 < 65 < got["d"]
    pairs = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 9.0), (3, 9.0)], "x int, y double")
    assert validation.spearman(pairs, "x", "y").first()["spearman"] == 1.0
    assert validation.spearman(pairs.limit(2), "x", "y").first()["spearman"] is None


def test_sweep_is_of_the_templated_score(spark):
    score = {r["review_id"]: r["templated"] for r in entry.queries()["templated_scores"](spark, DATA).collect()}
    labels = entry.queries()["cleaned_labels"](spark, DATA).collect()
    used = [(score[x["review_id"]], x["templated_label"] == "templated") for x in labels if x["review_id"] in score and x["templated_label"] in ("templated", "organic")]
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in entry.queries()["confusion_sweep"](spark, DATA).collect()}
    count = lambda t, over, truth: sum((s >= t) == over and y == truth for s, y in used)
    assert got == {t: (count(t, True, True), count(t, True, False), count(t, False, True), count(t, False, False)) for t in range(0, 101, 5)}
    assert len(used) > 5


@pytest.mark.parametrize("ratings, step", [([5] * 40, 1.0), ([1] * 24 + [5] * 16, 0.5), ([1] * 16 + [2] * 12 + [3] * 12, 0.15), ([1, 2, 3, 4] * 10, 0.0)])
def test_a_shift_of_spread_ratings_counts_less_as_evidence(spark, ratings, step):
    start = dt.date(2026, 1, 1)
    days = [(start + dt.timedelta(days=k), [4, 5]) for k in range(0, 60, 2)] + [(start + dt.timedelta(days=70), ratings)]
    rows = [(f"r{d}-{i}", "p", day, x, f"text {d} {i}") for d, (day, xs) in enumerate(days) for i, x in enumerate(xs)]
    rv = spark.createDataFrame(rows, "review_id string, place_id string, day date, rating int, text string")
    daily = temporal.daily_counts(rv)
    events = temporal.burst_events(daily)
    (event,), (shift,) = events.collect(), temporal.rating_shifts(daily, events).collect()
    share = max(ratings.count(s) for s in range(1, 6)) / len(ratings)
    assert shift["top_share"] == round(share, 4) and step == (1.0 if share >= 0.7 else 0.5 if share >= 0.5 else 0.15 if share >= 0.3 else 0.0)
    burst, moved = min(1.0, event["z_score"] / 10), min(1.0, shift["jsd"] / 0.3)
    near = {r["day"]: r["shift"] for r in temporal.agreed_strengths(events, temporal.rating_shifts(daily, events)).collect()}
    assert near == {start + dt.timedelta(days=k): pytest.approx(moved * step, abs=1e-4) for k in (69, 70, 71)}
    templated = spark.createDataFrame([(r[0], 0.0) for r in rows], "review_id string, templated double")
    got = {r["review_id"]: r["coordinated"] for r in scoring.review_evidence(rv, templated).collect()}
    dense = 0.5 + 0.5 * min(1.0, (len(ratings) - 1) / len(rows))
    assert got["r30-0"] == pytest.approx(0.35 * burst * (0.5 + 0.5 * moved * step) + 0.15 * dense, abs=0.002) and moved > 0.1


def _weights_by_hand(docs):
    """docs: lists of words. Per document {term: weight}: L2-normalised sublinear TF-IDF of 1- and 2-grams."""
    counts = [collections.Counter([*d, *(f"{x} {y}" for x, y in zip(d, d[1:]))]) for d in docs]
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for c in counts:
        x = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out.append({t: v / norm for t, v in x.items()})
    return out


def test_emerging_keywords_equal_brute_force_in_any_year(spark, tmp_path):
    rng, vocabulary, made = random.Random(4), "soup table waiter garden parking music dessert".split(), []
    for country, anchor in (("A", dt.date(2031, 5, 20)), ("B", dt.date(2024, 6, 1)), ("C", dt.date(1999, 3, 1))):
        made += [(country, anchor, age, rng.choices(vocabulary[: 5 if age > 30 else 7], k=6)) for age in [0, 30, 120, 121, *rng.sample(range(1, 150), 20)]]
    columns = spark.read.parquet(f"{DATA}/reviews.parquet").schema
    rows = []
    for i, (country, anchor, age, ws) in enumerate(made):
        known = {"review_id": f"r{i}", "place_id": "p", "reviewer_id": "u", "country": country, "text": " ".join(ws), "ingested_at": dt.datetime(2032, 1, 1)}
        known["published_at"] = f"{anchor - dt.timedelta(days=age)}T00:00:00.000000"
        rows.append(tuple(known.get(c) for c in columns.names))
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/reviews.parquet")
    spark.createDataFrame([], "source string, naive_zone string, date_order string").write.parquet(f"{tmp_path}/review_sources.parquet")
    got = {}
    for r in entry.queries()["emerging_keywords"](spark, str(tmp_path)).collect():
        got.setdefault(r["country"], {})[r["term"]] = (r["ratio"], r["recent"])
    assert set(got) == {"A", "B", "C"}
    for country, found in got.items():
        ref = [w for c, _, age, w in made if c == country and 30 <= age <= 120]
        new = [w for c, _, age, w in made if c == country and 0 <= age <= 30]
        by_hand = _weights_by_hand(ref + new)
        mean = lambda xs, t: sum(x.get(t, 0.0) for x in xs) / len(xs)
        both = {t: (mean(by_hand[len(ref) :], t), mean(by_hand[: len(ref)], t)) for x in by_hand for t in x}
        grown = {t: (a, b) for t, (a, b) in both.items() if (a + 1e-9) / (b + 1e-9) > 1}
        order = sorted(grown, key=lambda t: (grown[t][1] > 0, -grown[t][0] / (grown[t][1] or grown[t][0]), -round(grown[t][0], 6), t))
        assert set(found) == set(order[:10])
        for t, (ratio, recent) in found.items():
            a, b = grown[t]
            assert recent == pytest.approx(a, abs=1e-6) and (ratio is None) == (b == 0) and (b == 0 or ratio == pytest.approx((a + 1e-9) / (b + 1e-9), abs=1e-3))


def test_a_group_of_one_text_has_its_word_shares(spark):
    rows = [("one", "a", "The soup and the bread, the SOUP!"), ("one", "b", "  "), ("one", "c", None), ("two", "d", "fine soup"), ("two", "e", "cold bread"), ("none", "f", ""), ("mark", "g", "!!")]
    got = keywords.keywords(spark.createDataFrame(rows, "g string, doc string, text string"), "g", 3).collect()
    assert [(r["term"], r["score"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["g"] == "one"] == [("the", 0.428571, 1), ("soup", 0.285714, 2), ("and", 0.142857, 3)]
    assert {r["g"] for r in got} == {"one", "two"} and sum(r["g"] == "two" for r in got) == 3
