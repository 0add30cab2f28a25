import csv
import datetime as dt
import io
import random
import shutil

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from plumbline.operators import features, records, reviews, rolling
from plumbline.plans import general

FIELDS = (
    "review_id place_id place_name place_category reviewer_id reviewer_name rating text published_at city region country latitude longitude source source_url"
).split()


def test_current_review_takes_the_latest_and_is_order_free(spark):
    rows = [("a", 1, "2024-01-01"), ("a", 5, "2024-02-01"), ("a", 3, "2024-02-01"), ("b", None, None), (None, 1, "2024-01-01")]
    df = spark.createDataFrame(rows, "review_id string, rating int, ingested_at string")
    for x in (df, df.orderBy("rating")):
        assert {tuple(r) for r in reviews.current_reviews(x, ["rating"]).collect()} == {("a", 5), ("b", None)}


def test_features_match_a_plain_count(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["u1", "u2", None]), rng.choice(["x", "y", "z", None]), rng.choice([1, 5, None]), rng.choice([dt.date(2024, 1, k) for k in (1, 2, 9)] + [None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "reviewer_id string, place_category string, rating int, utc_day date")
    long = features.entity_type_table(df, "reviewer_id", "place_category")
    wide = {r["reviewer_id"]: r.asDict() for r in features.entity_features(long, "reviewer_id", "place_category", ["x", "y", "x"], "2024-02-01").collect()}
    for who in ("u1", "u2"):
        own = [r for r in rows if r[0] == who]
        assert wide[who]["review_count"] == len(own)
        assert wide[who]["n_x"] == sum(r[1] == "x" for r in own)
        assert wide[who]["n_other"] == sum(r[1] not in ("x", "y") for r in own)
        days = [r[3] for r in own if r[3]]
        assert wide[who]["recency_days"] == (dt.date(2024, 2, 1) - max(days)).days
        assert wide[who]["active_period_days"] == max(1, (max(days) - min(days)).days)
    assert features.entity_type_table(df.limit(0), "reviewer_id", "place_category").count() == 0
    with pytest.raises(ValueError):
        features.type_list(df, "place_category", 2)


def test_features_of_each_type_match_a_plain_count(spark):
    rng = random.Random(2)
    days = [dt.date(2024, 1, k) for k in (1, 2, 9)] + [None, None]
    rows = [(rng.choice(["u1", "u2", "u3", None]), rng.choice(["x", "y", "a.b`c", "z", None]), rng.choice([1, 5, None]), rng.choice(days)) for _ in range(60)]
    rows += [("u4", "x", None, None)]
    df = spark.createDataFrame(rows, "reviewer_id string, place_category string, rating int, utc_day date")
    long = features.entity_type_table(df, "reviewer_id", "place_category")
    got = {r["reviewer_id"]: r.asDict() for r in features.entity_features(long, "reviewer_id", "place_category", ["x", "y", "a.b`c"], "2024-02-01").collect()}
    assert set(got) == {"u1", "u2", "u3", "u4"}
    for who, row in got.items():
        for kind in ("x", "y", "a.b`c", "other"):
            own = [r for r in rows if r[0] == who and (r[1] == kind or kind == "other" and r[1] in ("z", None))]
            dated, rated = sorted(r[3] for r in own if r[3]), [r[2] for r in own if r[2] is not None]
            want = {
                "n": len(own), "dated_count": len(dated), "first_day": dated[0] if dated else None, "last_day": dated[-1] if dated else None,
                "active_period_days": max(1, (dated[-1] - dated[0]).days) if dated else None, "recency_days": (dt.date(2024, 2, 1) - dated[-1]).days if dated else None,
                "rating_sum": sum(rated) if rated else None, "rating_avg": sum(rated) / len(rated) if rated else None,
            }
            assert {c: row[f"{c}_{kind}"] for c in want} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=1, max_size=25), min_size=1, max_size=5), st.integers(1, 9), st.sampled_from(["sum", "min", "max"]))
def test_two_stack_equals_brute_force(runs, window, how):
    values, lengths = np.array([x for r in runs for x in r], float), np.array([len(r) for r in runs])
    plain = {"sum": sum, "min": min, "max": max}[how]
    want = [plain(r[max(0, i - window + 1) : i + 1]) for r in runs for i in range(len(r))]
    assert rolling.two_stack(values, lengths, window, how).tolist() == want


def test_rolling_days_include_idle_days(spark):
    d = lambda k: dt.date(2024, 1, k)
    rows = [("p", d(1), 4), ("p", d(1), 2), ("p", d(5), None), ("p", d(9), 5), ("q", d(3), 1), ("q", None, 1), (None, d(3), 1)]
    df = spark.createDataFrame(rows, "place_id string, day date, rating int")
    got = {(r["place_id"], r["activity_day"]): r for r in rolling.rolling_days(df, "place_id", "day", "rating", (3, 7)).collect()}
    assert len(got) == 10
    assert got["p", d(2)]["events_3"] == 2 and got["p", d(2)]["events"] == 0 and got["p", d(2)]["value_avg_3"] == 3
    assert got["p", d(5)]["events_3"] == 1 and got["p", d(5)]["value_avg_3"] is None and got["p", d(5)]["value_sum_7"] == 6
    assert got["p", d(9)]["value_max_7"] == 5 and got["p", d(9)]["value_min_7"] == 5 and got["p", d(9)]["day_number"] == 9
    assert rolling.rolling_days(df.limit(0), "place_id", "day", "rating").count() == 0


def _reference_state(text, sep):
    """One character at a time; the fields, or None for broken quoting."""
    fields, now, state = [], "", "start"
    for ch in text:
        if state == "quoted":
            state, now = ("closed", now) if ch == '"' else (state, now + ch)
        elif ch == sep:
            fields, now, state = [*fields, now], "", "start"
        elif ch == '"':
            if state == "start":
                state = "quoted"
            elif state == "closed":
                state, now = "quoted", now + '"'
            else:
                return None
        elif state == "closed":
            return None
        else:
            state, now = "plain", now + ch
    return None if state == "quoted" else [*fields, now]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet='a",;\n б', max_size=40), min_size=1, max_size=8), st.sampled_from([",", ";"]))
def test_tokenizer_equals_brute_force(lines, sep):
    got, errors = records.tokenize(lines, [sep] * len(lines))
    for line, fields, error in zip(lines, got, errors, strict=True):
        assert fields == _reference_state(line, sep)
        assert (error is None) == (fields is not None)


def test_long_records_cross_chunks_and_round_trip():
    rows = [["x" * 3000, 'say "hi"', "a\nb", ""], ["1", "," * 700, '"' * 501, "é"]]
    out = io.StringIO()
    csv.writer(out, lineterminator="\x00").writerows(rows)
    lines = out.getvalue().split("\x00")[:-1]
    assert records.tokenize(lines, [","] * 2)[0] == rows


def test_reasons_and_types(spark):
    base = dict.fromkeys(FIELDS, "") | {"review_id": "r", "place_id": "p", "reviewer_id": "u", "rating": "4,5", "latitude": " +5 0,5", "longitude": "200"}
    line = lambda **kw: ",".join('"' + v + '"' if "," in v else v for v in (base | kw).values())
    cases = [
        (line(), None), (line(rating=""), None), (line(rating="★★★ 3"), None), (line(rating="9"), "rating"), (line(rating="-3"), "rating"), (line(rating="five"), "rating"),
        (line(latitude="91"), "latitude"), (line(latitude="1e1"), "latitude"), (line(latitude="nan"), "latitude"), (line(place_id=" "), "key"), (line() + ",", "columns"),
        ('"open', "quoting"), ('a"b', "quoting"), ('"a" ,b', "quoting"), ("", "columns"), (None, "columns"),
    ]
    df = spark.createDataFrame([(i, x, ",") for i, (x, _) in enumerate(cases)], "line_id long, raw_line string, field_sep string")
    got = {r["line_id"]: r for r in records.parse_records(df, FIELDS).collect()}
    for i, (text, reason) in enumerate(cases):
        assert got[i]["reason"] == reason, text
    assert got[0]["rating"] == 4 and got[0]["latitude"] == 50.5 and got[0]["longitude"] is None and got[0]["city"] is None
    assert got[11]["error_offset"] == 0 and got[12]["error_offset"] == 1 and got[13]["error_offset"] == 3
    assert got[9]["error_field"] == 2
    assert records.parse_records(df.limit(0), FIELDS).count() == 0


def test_features_of_types_whose_names_clash(spark):
    rows = [("u", "other", 1), ("u", "Cafe", 2), ("u", "cafe", 3), ("u", "new", 4)]
    df = spark.createDataFrame(rows, "reviewer_id string, place_category string, rating int").withColumn("utc_day", F.lit(None).cast("date"))
    long = features.entity_type_table(df, "reviewer_id", "place_category")
    wide = features.entity_features(long, "reviewer_id", "place_category", ["other", "Cafe", "cafe"])
    row = wide.select("*").first().asDict()
    assert (row["rating_sum_other"], row["rating_sum_Cafe"], row["rating_sum_cafe_2"], row["rating_sum_other_2"], row["rating_sum"]) == (1, 2, 3, 4, 10)
    assert {(r["type"], r["rating_sum"]) for r in features.by_type(wide, "reviewer_id", ["other", "Cafe", "cafe"]).collect()} == {("other", 1), ("Cafe", 2), ("cafe", 3)}


@pytest.mark.parametrize("held", [500, 2])
def test_short_categories_are_read_from_the_pivoted_table(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(general, "TYPES", held, raising=False)
    rng = random.Random(4)
    kinds, days = ["other", "Other", "a.b`c", "", "it's", None], ["2024-02-28", "2024-02-29", "2024-03-01", "never", None]
    rows = []
    for who in ("u1", "u2", "u3", None):
        for kind in kinds:
            some = rng.choice([days[:2] + days[3:], days[1:], days[::2]])
            rows += [(f"r{len(rows) + i}", who, kind, 5, rng.choice(some), "s", "2024-05-01") for i in range(rng.randint(3, 9))]
    rows += [(*r[:3], 1, *r[4:6], "2024-06-01") for r in rows[::3]]
    fields = "review_id string, reviewer_id string, place_category string, rating int, published_at string, source string, ingested_at string"
    write = lambda df, name: df.write.parquet(f"{tmp_path}/{name}.parquet")
    write(spark.createDataFrame([("s", "UTC", "dmy")], "source string, naive_zone string, date_order string"), "review_sources")

    def found(some):
        shutil.rmtree(tmp_path / "reviews.parquet", ignore_errors=True)
        write(spark.createDataFrame(some, fields), "reviews")
        df = general.p1_found(spark, str(tmp_path))
        return sorted(map(tuple, df.collect())), "pivotfirst" in df._jdf.queryExecution().optimizedPlan().toString()

    dated = {}
    for r in {r[0]: r for r in rows}.values():
        if r[1] and r[2] is not None and r[4] and r[4] != "never":
            dated.setdefault(r[1:3], []).append(dt.date.fromisoformat(r[4]))
    want = sorted(k for k, v in dated.items() if len(v) >= 4 and (max(v) - min(v)).days <= 1)
    assert found(rows) == (want, True) and 3 <= len(want) < len(dated)
    assert found([r for r in rows if r[2] is None])[0] == []
    assert len(features.type_list(spark.range(1100).selectExpr("string(id) AS k"), "k", None)) == 1100
