import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import components, mixing, neardup, packing, queries, splitting, vectors

DATA = "/root/testdata/sf0.001"
TOKEN = re.compile(r"\w+|[^\w\s]+")


@pytest.mark.parametrize("name", ["p2_found", "p2_groups", "p5_found", "p5_neighbours", "p8_found", "p8_check", "p9_found", "p9_plan", "p9_check", "p10_found", "p10_pieces"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("duplicate_edges", "reviews", "embeddings_cache", "documents", "mix_targets"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(rel.fetchall())


@pytest.mark.parametrize("bound", [10**6, 40])
def test_components_in_one_step_and_in_levels(spark, bound, monkeypatch):
    monkeypatch.setattr(components, "HOT", 30)
    rng = random.Random(3)
    pairs = [(f"n{a:03d}", f" n{b:03d} ") for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(110))]
    pairs += [(f"hub{0}", f"leaf{i}") for i in range(60)] + [("solo", "solo"), (None, "x"), ("", "y")]
    df = spark.createDataFrame(pairs * 2, "review_id_a string, review_id_b string").repartition(5)
    got = {r["review_id"]: r["group_id"] for r in components.connected_groups(df, edges_per_task=bound).collect()}
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = (a or "").strip(), (b or "").strip()
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}
    assert components.connected_groups(df.limit(0)).count() == 0
    lists = components.group_lists(spark.createDataFrame(list(got.items()), "review_id string, group_id string"), most=10).collect()
    assert sum(len(r["review_ids"]) for r in lists) == len(got)


@pytest.mark.parametrize("shape", ["chain", "star", "pairs"])
def test_components_end_in_few_rounds(spark, shape):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    n = 100_000 if shape == "chain" else 5_000
    ids = [f"v{i:06d}" for i in range(n + 1)]
    pairs = {"chain": zip(ids, ids[1:]), "star": (("hub", x) for x in ids[1:]), "pairs": zip(ids[1::2], ids[2::2])}[shape]
    table = pa.table(dict(zip(("review_id_a", "review_id_b"), map(list, zip(*pairs, strict=True)), strict=True)))
    rounds: list[int] = []
    groups = components.connected_groups(spark.createDataFrame(table).repartition(8, "review_id_b"), edges_per_task=500, rounds=rounds)
    sizes = {r["group_id"]: r["n"] for r in groups.groupBy("group_id").count().withColumnRenamed("count", "n").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {"chain": {ids[0]: n + 1}, "star": {"hub": n + 1}, "pairs": {x: 2 for x in ids[1::2]}}[shape]
    assert sizes == want and len(rounds) <= 14
    assert all(b <= 0.8 * a for a, b in zip(rounds, rounds[1:]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60), st.integers(2, 12))
def test_components_of_any_graph_in_levels(spark, pairs, bound):
    named = [(f"n{a}", f"n{b}") for a, b in pairs]
    df = spark.createDataFrame(named, "review_id_a string, review_id_b string").repartition(3)
    got = {r["review_id"]: r["group_id"] for r in components.connected_groups(df, edges_per_task=bound).collect()}
    own = {x: {x} for p in named if p[0] != p[1] for x in p}
    for a, b in named:
        if a != b and own[a] is not own[b]:
            own[a] |= own[b]
            for x in own[b]:
                own[x] = own[a]
    assert got == {x: min(g) for x, g in own.items()}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=20))
def test_packing_uses_every_item_once_within_capacity(histogram):
    plan = packing.pack_sizes(histogram, 30)
    used: dict[int, int] = {}
    for uses, copies in plan:
        assert copies > 0 and sum(s * u for s, u in uses) <= 30
        for s, u in uses:
            used[s] = used.get(s, 0) + u * copies
    assert used == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(c for _, c in plan) <= 11 / 9 * max(1, -(-total // 30)) * 1.4 + 1


def test_pack_ties_zero_and_oversized(spark):
    rows = [(i, 7) for i in range(500)] + [(1000, 25), (1001, 0), (1002, None), (1003, 20), (1003, 20)]
    df = spark.createDataFrame(rows, "doc_id long, n int")
    got = packing.pack(df, "doc_id", "n", 10, rows_per_task=300).collect()
    fill: dict[int, int] = {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["piece_size"]
    assert max(fill.values()) <= 10 and sorted(fill) == list(range(len(fill))) and sum(fill.values()) == 3500 + 25 + 40
    assert sorted(r["piece_size"] for r in got if r["doc_id"] == 1000) == [5, 10, 10]
    assert packing.pack(df.limit(0), "doc_id", "n", 10).count() == 0


def test_best_fit_takes_the_container_with_the_least_room():
    counts = np.zeros(11, np.int64)
    counts[[7, 6, 3, 2]] = 1
    assert sorted(sorted(uses) for uses, _ in packing.best_fit(counts, 10)) == [[(2, 1), (6, 1)], [(3, 1), (7, 1)]]  # 3 goes beside 7, not beside 6
    rng = np.random.default_rng(1)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(rng.integers(1, 2049, 4000), return_counts=True), strict=True)}
    plan = packing.pack_sizes(histogram, 2048)
    assert sum(c for _, c in plan) <= sum(s * n for s, n in histogram.items()) / 2048 * 1.02 + 1


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 400, 300).astype(float)
    mean = np.zeros(300)
    for k in range(300):
        p = mixing.pivotal(np.full(300, 0.37), w, np.random.default_rng(k))
        assert abs((p * w).sum() - 0.37 * w.sum()) < 1e-6 * w.sum()
        assert w[(p > 0) & (p < 1)].sum() <= np.sort(w)[60]
        mean += p / 300
    assert abs(mean.mean() - 0.37) < 0.02


@pytest.mark.parametrize("hold", ["shares", "tokens"])
def test_mix_respects_caps_and_shares(spark, hold):
    rng = random.Random(5)
    rows = [(i, " Big " if i % 3 else "small", rng.randrange(1, 60)) for i in range(3000)] + [(9001, None, 5), (9002, "else", 5), (9003, "small", 0), (9004, "small", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(df, targets, "doc_id", "n", rows_per_task=40, hold=hold)
    got = selection.collect()
    assert {r["doc_id"] for r in got} == set(range(3000)) | {9003, 9004}
    assert all(r["copies"] <= 1 for r in got)
    out = {r["source"]: r for r in report.collect()}
    assert out["none"]["capped"] and out["small"]["capped"] and not out["big"]["capped"] and out["none"]["actual_tokens"] == 0
    smallest = sorted(x for _, s, x in rows if x and s)[300]
    if hold == "shares":
        assert out["small"]["actual_tokens"] == out["small"]["tokens"]
        assert abs(out["small"]["actual_share"] - 5 / 9) < 1e-3 and abs(out["big"]["actual_share"] - 4 / 9) < 1e-3
    else:
        assert out["big"]["target_tokens"] == pytest.approx(0.4 * (out["big"]["tokens"] + out["small"]["tokens"]))
    assert abs(out["big"]["actual_tokens"] - out["big"]["target_tokens"]) <= smallest
    assert sorted(map(tuple, selection.collect())) == sorted(map(tuple, got))  # the same draw again
    assert mixing.mix(df.limit(0), targets, "doc_id", "n")[0].count() == 0


def test_mix_does_not_draw_what_the_rest_cannot_make_up_for():
    for k in range(50):
        p = mixing.pivotal(np.full(40, 0.1), np.r_[900.0, np.full(39, 10.0)], np.random.default_rng(k))
        assert p[0] == 0 and abs(p[1:].sum() * 10 - 129) < 1e-6


def test_split_round_trip_limits_and_overlap(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["слово", "word", "Wort", "x" * 3000, "a", "..."])
    docs = ["".join(word() + rng.choice([" ", " ", " ", ". ", ".\n", "\n\n", "\r\n", "? "]) for _ in range(n)) for n in (1, 30, 300, 900)] + ["one " * 500, " \n " * 90, "", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    whole = splitting.split_texts(df, "doc_id", "text", 40, 0).collect()
    for i, d in enumerate(docs):
        own = sorted((r for r in whole if r["doc_id"] == i), key=lambda r: r["piece_no"])
        if len(TOKEN.findall(d or "")) > 40:
            assert "".join(r["piece"] for r in own).strip() == d.strip()
            assert all(len(TOKEN.findall(r["piece"])) == r["piece_tokens"] <= 40 for r in own)
            most = max(len(TOKEN.findall(x)) for x in re.split(r"\n|(?<=[.!?…])\s", d))
            assert max(r["forced"] for r in own) == int(most > 40)
        else:
            assert not own
    pieces = splitting.split_texts(df, "doc_id", "text", 40, 8).collect()
    assert max(r["piece_tokens"] for r in pieces) <= 40
    by = {(r["doc_id"], r["piece_no"]): TOKEN.findall(r["piece"]) for r in pieces}
    assert all(by[d, k][:8] == by[d, k - 1][-8:] for d, k in by if k > 1 and len(by[d, k - 1]) >= 8)


def test_split_takes_long_texts_and_large_limits(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["word", "слово", "x.", "y?!", "z\n", "q\n\n"]) for _ in range(1_000_000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    for limit in (512, 2048, 8192, 32768):
        pieces = splitting.split_texts(df, "doc_id", "text", limit, 0).orderBy("piece_no").collect()
        assert "".join(r["piece"] for r in pieces) == text and max(r["piece_tokens"] for r in pieces) <= limit and not any(r["forced"] for r in pieces)
    joined = splitting.split_texts(spark.createDataFrame([(1, "word " * 60_000)], "doc_id int, text string"), "doc_id", "text", 2048, 100).collect()
    assert sum(r["piece_tokens"] for r in joined) == 60_000 + 100 * (len(joined) - 1) and sum(r["forced"] for r in joined) == len(joined) - 1


def _unit(n, dim, rng):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_with_copies_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 64)
    rng = np.random.default_rng(4)
    centres = _unit(60, 32, rng)
    x = np.concatenate([centres[i % 60] + 0.05 * _unit(1, 32, rng)[0] for i in range(400)]).reshape(400, 32)
    x[300:] = x[300]  # a quarter are copies
    rows = [(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 32), ("short", [1.0] * 5), ("null", None), ("hole", [None] + [1.0] * 31), (None, [1.0] * 32), ("k300", x[300].tolist())]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = vectors.similar_vectors(df, "id", "v", 32, k=5, min_cosine=0.8, recall=0.97).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(f"k{i:03d}", f"k{j:03d}") for i in range(400) for j in sorted((j for j in range(400) if j != i and s[i, j] >= 0.8), key=lambda j: (-s[i, j], j))[:5]}
    found = {(r["id"], r["neighbour"]) for r in got}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.1 * len(want)
    assert {b for a, b in found if a == "k399"} == {f"k{i}" for i in range(300, 305)}
    assert {b for a, b in found if a == "k301"} == {"k300", "k302", "k303", "k304", "k305"}
    assert vectors.similar_vectors(df.limit(0), "id", "v", 32).count() == 0


def test_vectors_round_one_centre_leave_their_leaf_as_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = _unit(1, 48, rng) + 0.25 * _unit(4000, 48, rng)
    df = spark.createDataFrame(pd.DataFrame({"id": [f"k{i:04d}" for i in range(4000)], "v": x.tolist()}), "id string, v array<double>")
    sizes = {}
    keep = vectors.materialise

    def counted(frame, label):
        out = keep(frame, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(vectors, "materialise", counted)
    got = vectors.similar_vectors(df, "id", "v", 48).collect()
    assert sizes["found"] <= 4000 * 2 and sizes["cosines"] <= 4000 * 6
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 2 * np.eye(4000)
    want = {(f"k{i:04d}", f"k{j:04d}") for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    assert len(want & {(r["id"], r["neighbour"]) for r in got}) >= 0.97 * len(want)


def test_recall_with_four_cuts_of_the_real_leaf(spark):
    rng = np.random.default_rng(5)
    n = 16 * vectors.LEAF
    x = np.repeat(_unit(n // 4, 32, rng), 4, axis=0) + 0.4 * _unit(n, 32, rng)
    assert vectors.trees_needed(n, 0.8, 0.9)[0] == 4
    ids = np.array([f"k{i:06d}" for i in range(n)])
    table = pa.table({"id": ids, "v": pa.FixedSizeListArray.from_arrays(x.ravel(), 32).cast(pa.list_(pa.float64()))})
    got = vectors.similar_vectors(spark.createDataFrame(table), "id", "v", 32).where("substring(id, 2) % 50 = 0").collect()
    found = {(r["id"], r["neighbour"]) for r in got}
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    asked = np.arange(0, n, 50)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    top = np.argpartition(-s, 5, axis=1)[:, :5]
    want = {(ids[i], ids[j]) for r, i in enumerate(asked) for j in top[r] if s[r, j] >= 0.8}
    assert len(want) > 2000 and len(found & want) >= 0.9 * len(want)


def test_vector_codec_is_exact():
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(-100, 100, 16) / 128, rng.standard_normal(16).astype(np.float32), rng.standard_normal(16), np.full(16, 1e300)])
    assert all((vectors.unpack_vector(b) == v).all() for b, v in zip(vectors.pack_vector(x), x, strict=True))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("абвгдеabcdef") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25, 60))) for _ in range(120)]
    rows = [(f"r{i:03d}", t) for i, t in enumerate(texts)]
    for i in range(150):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((f"s{i:03d}", "  ".join(words).upper()))
    rows += [("n1", None), ("n2", ""), ("n3", "short"), (None, texts[0]), ("r000", texts[0]), ("long", "я" * 70_000), ("long2", "я" * 70_000)]
    df = spark.createDataFrame(rows, "review_id string, text string")
    members, links = neardup.similar_texts(df, "review_id", "text", recall=0.9999)
    got = {tuple(r) for r in neardup.expand_pairs(members, links, "review_id").collect()}
    sets = {k: neardup.gram_set(" ".join(t.lower().split())) for k, t in rows if k and t and len(" ".join(t.split())) >= 100}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == want and ("long", "long2") in got
    empty = neardup.similar_texts(df.limit(0), "review_id", "text")
    assert neardup.expand_pairs(*empty, "review_id").count() == 0


def test_many_copies_are_linked_through_one(spark):
    text = "the same sentence again and again, " * 5
    rows = [(f"c{i:02d}", text) for i in range(20)] + [("d", text + "but once.")]
    members, links = neardup.similar_texts(spark.createDataFrame(rows, "review_id string, text string"), "review_id", "text", recall=0.999)
    got = {tuple(r) for r in neardup.expand_pairs(members, links, "review_id", copies=5).collect()}
    assert got == {("c00", f"c{i:02d}") for i in range(1, 20)} | {("c00", "d")}
    assert {tuple(r) for r in neardup.group_members(members, links, "review_id").collect()} == {(k, "c00") for k, _ in rows}


def test_lists_that_many_texts_share_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(6)
    base = "the very same long sentence stands in each of these many texts, with a number at its end to tell them apart: "
    rows = [(f"r{i:04d}", base + str(rng.randrange(10**9))) for i in range(300)]
    df = spark.createDataFrame(rows, "review_id string, text string")
    whole = {tuple(r)[:2] for r in neardup.similar_texts(df, "review_id", "text", recall=0.999)[1].collect()}
    monkeypatch.setattr(neardup, "SPLIT", 50)
    monkeypatch.setattr(neardup, "SAMPLED", 3)
    plain = df.select(F.col("review_id").alias("id"), F.xxhash64("text").alias("t"), F.col("text").alias("x"))
    rows_, bands = neardup.banding(300, 0.7, 0.999)
    keys, parts = neardup.crowded_lists(plain, rows_, bands, 5)
    assert len(keys) > 5 and parts.max() >= 4
    assert {tuple(r)[:2] for r in neardup.similar_texts(df, "review_id", "text", recall=0.999)[1].collect()} == whole and len(whole) > 30_000
    entries = np.repeat(keys[parts.argmax()], 1000)
    row, key, side = neardup.cut_lists(entries, np.arange(1000), keys, parts)
    assert np.bincount(np.unique(key, return_inverse=True)[1]).max() < 1000 and sorted(np.unique(side)) == [0, 1, 2] and len(np.unique(row)) == 1000


@pytest.mark.parametrize("block", [4, 500])
def test_all_copies_are_linked(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    text, other = "the same sentence again and again, " * 5, "another matter that nobody else has written of, " * 5
    copies = {"c": text, "d": text + "but once.", "e": text + "but once!", "f": other}
    rows = [(f"{k}{i:03d}", copies[k]) for k, n in (("c", 120), ("d", 7), ("e", 1), ("f", 6)) for i in range(n)]
    members, links = neardup.similar_texts(spark.createDataFrame(rows * 2, "review_id string, text string"), "review_id", "text", recall=0.999)
    got = [tuple(r) for r in neardup.all_pairs(members, links, "review_id").collect()]
    ids = sorted(k for k, _ in rows)
    assert sorted(got) == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (a[0] == "f") == (b[0] == "f")]


def test_p7_found_has_every_copy(spark, tmp_path):
    text = "the same sentence again and again, " * 5
    rows = [(f"c{i:03d}", text) for i in range(103)] + [("d", text + "but once.")]
    spark.createDataFrame(rows, "review_id string, text string").write.parquet(f"{tmp_path}/reviews.parquet")
    assert queries.p7_found(spark, str(tmp_path)).count() == 104 * 103 // 2


@pytest.mark.parametrize("recall", [0.9, 0.99, 0.9999])
def test_recall_counts_what_sketches_lose(recall):
    least, lost = neardup.sketch_bound(0.7, recall)
    agree = np.random.default_rng(3).binomial(neardup.BITS, 0.85, 2_000_000)
    assert lost == pytest.approx((agree < least).mean(), abs=5e-4) and lost <= (1 - recall) / 10
    for size in (5_000, 500_000, 50_000_000):
        rows, bands = neardup.banding(size, 0.7, recall)
        assert (1 - (1 - 0.7**rows) ** bands) * (1 - lost) >= recall
