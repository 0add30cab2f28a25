"""The signals of reuse from one shuffle of the texts."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.operators import reuse, temporal, texts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reviews(spark):
    r = random.Random(3)
    words = "вежливые люди suppe kam spät терраса шумно bestellt lunch arrived cold the и garten voll wifi slow".split()
    said = [" ".join(r.choice(words) for _ in range(r.randint(3, 12))) + r.choice([".", "! Ja…", " \n. так. "]) for _ in range(40)]
    rows = []
    for i in range(400):
        text = r.choice([None, "", "?!", *said * 2]) if i % 3 else r.choice(said) + " " + r.choice(words)
        rows.append((f"r{i}", r.choice(["a", "a", "b", "c", None]), r.choice([None, *[date(2024, 1, 1) + timedelta(days=k) for k in range(0, 90, 4)]]), text))
    rows.append(("r400", "alone", date(2024, 1, 5), said[0]))
    return texts.with_specificity(spark.createDataFrame(rows, "review_id string, place_id string, day date, text string")).cache()


@pytest.mark.parametrize("whole", [20_000, 60])
def test_signals_equal_the_single_operators(reviews, whole):
    got = {r["review_id"]: r.asDict() for r in reuse.place_signals(reviews, whole=whole).collect()}
    assert len(got) == 401
    days = temporal.peer_counts(reviews.where("place_id IS NOT NULL AND day IS NOT NULL").groupBy("place_id", "day").agg(F.count("*").alias("n")))
    parts = {
        "phrase_reuse": texts.phrase_reuse(reviews), "low_unique_detail": texts.unique_detail(reviews.na.fill("", ["place_id"])), "peers": texts.bigram_peers(reviews),
        "structure": texts.structure_similarity(reviews.where("place_id IN ('a', 'b', 'c')")), "uniformity": reviews.join(texts.style_uniformity(reviews), "place_id"),
        "temporal": reviews.join(days.withColumn("temporal", F.least("peers", F.lit(5)) / 5), ["place_id", "day"]),
    }
    for name, part in parts.items():
        want = {r["review_id"]: r[name] for r in part.collect()}
        assert any(want.values()), name
        assert {k: v[name] for k, v in got.items()} == {k: want.get(k, name == "temporal") or 0 for k in got}, name


def test_specificity_of_tables_equals_the_expression(reviews):
    more = ["Официант принёс капучино за 20 минут, потом всё отлично", "Чека wi-fi ждал", "Персонал супер"]
    rv = reviews.drop("spec").union(reviews.sparkSession.createDataFrame([(f"x{i}", "a", None, t) for i, t in enumerate(more)], "review_id string, place_id string, day date, text string"))
    want, got = texts.with_specificity(rv), texts.specificity_table(rv)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _written(spark, name, tmp_path):
    """Bytes that the tasks of a query shuffle, and its rows."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        every = sc.statusStore().executorList(True)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = shuffled()
    entry.queries()[name](spark, DATA).write.parquet(str(tmp_path / name))
    return shuffled() - before, spark.read.parquet(str(tmp_path / name)).count()


def _size(*tables):
    return sum(os.path.getsize(f"{DATA}/{t}.parquet") for t in tables)


def test_challenge_strata_shuffles_little(spark, tmp_path):
    written, rows = _written(spark, "challenge_strata", tmp_path)
    assert rows > 0 and written < 15 * _size("reviews", "duplicate_edges")


@pytest.mark.parametrize("name", ["place_summary", "coordinated_places", "review_weights"])
def test_scores_shuffle_little(spark, tmp_path, name):
    written, rows = _written(spark, name, tmp_path)
    assert rows > 0 and written < 15 * _size("reviews", "duplicate_edges", "embeddings_cache")
