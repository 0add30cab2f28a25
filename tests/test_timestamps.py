import datetime as dt
from zoneinfo import ZoneInfo

from plumbline.operators import timestamps as ts

SOURCES = [("berlin", "Europe/Berlin", "dmy"), ("york", "America/New_York", "mdy"), ("lordhowe", "Australia/Lord_Howe", "dmy")]
CASES = [
    ("2024-05-06T07:08:09.123456", None, "2024-05-06T07:08:09.123456"),
    (" 2024-05-06T07:08:09.123456\n", "berlin", "2024-05-06T07:08:09.123456"),
    ("2024-05-06 07:08", "berlin", "2024-05-06T05:08:00.000000"),
    ("2024-05-06", "berlin", "2024-05-06T00:00:00.000000"),
    ("1715000000", None, "2024-05-06T12:53:20.000000"),
    ("1715000000123", None, "2024-05-06T12:53:20.123000"),
    ("1715000000123456", None, "2024-05-06T12:53:20.123456"),
    ("1715000000.25", None, "2024-05-06T12:53:20.250000"),
    ("03/04/2024 10:00", "york", "2024-03-04T15:00:00.000000"),
    ("03/04/2024 10:00", "berlin", "2024-04-03T08:00:00.000000"),
    ("31.12.23, 23:59", None, "2023-12-31T23:59:00.000000"),
    ("12/31/2023 12:05 am", "york", "2023-12-31T05:05:00.000000"),
    ("7 мая 2024 10:00", None, "2024-05-07T10:00:00.000000"),
    ("Sep 2, 2024 9:56 PM", None, "2024-09-02T21:56:00.000000"),
    ("Fri, 29 Jul 2022 10:40:18 +0300", None, "2022-07-29T07:40:18.000000"),
    ("2024-05-06T07:08:09.123456789-05:00", None, "2024-05-06T12:08:09.123456"),
    ("2024-05-06 07:08:09 America/New_York", None, "2024-05-06T11:08:09.000000"),
    ("2024-05-06 07:08:09 [Europe/Berlin]", "york", "2024-05-06T05:08:09.000000"),
    ("2024-05-06 07:08:09 EST", "berlin", "2024-05-06T12:08:09.000000"),
    ("2024-10-27 02:30", "berlin", "2024-10-27T00:30:00.000000"),  # twice: the offset before the change
    ("2024-03-31 02:30", "berlin", "2024-03-31T01:30:00.000000"),  # never: the offset before the change
    ("2024-04-07 01:45", "lordhowe", "2024-04-06T14:45:00.000000"),  # a change of half an hour
    ("2024-02-30 10:00", None, None),
    ("2024-13-05T10:00:00Z", None, None),
    ("2024-05-06T25:00:00", None, None),
    ("13:00 PM", None, None),
    ("2024-05-06 07:08:09 Mars/Olympus", None, None),
    ("yesterday", None, None),
    ("", None, None),
    (None, None, None),
]


def test_every_form(spark):
    rows = [(i, x, s) for i, (x, s, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "review_id int, published_at string, source string")
    conf = spark.createDataFrame(SOURCES, "source string, naive_zone string, date_order string")
    got = {r["review_id"]: r["published_utc"] for r in ts.normalise_timestamps(df, conf).collect()}
    for i, (text, source, want) in enumerate(CASES):
        assert got[i] == want, (text, source, got[i])


def test_intervals_agree_with_the_zone_rules():
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata"):
        spans = ts.offset_intervals(zone)
        for year in range(1950, 2051, 7):
            for month in (1, 4, 7, 10):
                t = dt.datetime(year, month, 3, 5, tzinfo=dt.timezone.utc)
                want = int(t.astimezone(ZoneInfo(zone)).utcoffset().total_seconds())
                assert [o for a, b, o in spans if a <= t.timestamp() < b] == [want]


def test_clashing_names_repeats_and_empty(spark):
    df = spark.createDataFrame([("a", "2024-01-01", "x", 1), ("a", "2024-01-01", "x", 2), (None, "2024-01-01", None, 3)], "review_id string, published_at string, source string, instant_us int")
    out = ts.with_instants(df)
    assert out.columns.count("instant_us") == 1 and out.count() == 3
    assert ts.normalise_timestamps(df).count() == 1
    assert ts.normalise_timestamps(df.limit(0)).count() == 0


def test_no_short_interval_of_a_zone_is_missed():
    import zoneinfo

    zone = zoneinfo.ZoneInfo("Asia/Gaza")
    spans = ts.offset_intervals("Asia/Gaza")
    for k in range(3 * 365):
        t = dt.datetime(2040, 1, 1, 12, tzinfo=dt.timezone.utc) + dt.timedelta(days=k)
        s = int(t.timestamp())
        assert next(o for a, b, o in spans if a <= s < b) == t.astimezone(zone).utcoffset().total_seconds()
