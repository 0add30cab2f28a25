import datetime as dt
import gzip
import json

import pytest

from plumbline.sources import annotations, files, labels, providers
from plumbline.sources.store import Store
from plumbline.streaming import daily


def test_csv_encodings_aliases_and_rejects(spark, tmp_path):
    text = 'id,org_id,user_id,stars,comment,date,lat,lng\n1,p,u,"4,7","Вкусно,\nочень ""да""",01.02.2024,"55,5",37\n2,p,,9, ,never,95,x\n'
    for name, data in (("a.csv", text.encode()), ("b.csv", b"\xef\xbb\xbf" + text.encode()), ("c.csv", text.encode("cp1251"))):
        (tmp_path / name).write_bytes(data)
        rows = {r["review_id"]: r for r in files.normalise_rows(files.read_reviews(spark, str(tmp_path / name))).collect()}
        assert rows["1"]["text"] == 'Вкусно,\nочень "да"' and rows["1"]["rating"] == 4 and rows["1"]["latitude"] == 55.5, name
        assert rows["1"]["published_at"] == "2024-02-01T00:00:00.000000" and rows["1"]["reject_reason"] is None and rows["1"]["warnings"] == []
        assert rows["2"]["reject_reason"] == "missing required key 'reviewer_id'" and rows["2"]["warnings"] == ["rating", "published_at", "coordinates", "text"]
    assert files.import_counters(files.normalise_rows(files.read_csv(spark, str(tmp_path / "a.csv")))).first()[:3] == (2, 1, 1)


def test_json_shapes(spark, tmp_path):
    rows = [{"review_id": "1", "place_id": "p", "reviewer_id": "u", "rating": 5}, {"review_id": "1", "rating": 1}, {"ID": "2", "place_id": "p", "user_id": "v"}]
    for name, doc in (("a.json", [*rows, 7]), ("b.json", {"reviews": rows}), ("c.json", {str(i): r for i, r in enumerate(rows)})):
        (tmp_path / name).write_text(json.dumps(doc))
        got = {r["review_id"]: r for r in files.normalise_rows(files.read_reviews(spark, str(tmp_path / name))).collect()}
        assert set(got) == {"1", "2"} and got["1"]["rating"] == 5 and got["2"]["reviewer_id"] == "v", name
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows[:1]))
    assert files.normalise_rows(files.read_reviews(spark, str(tmp_path / "d.jsonl.gz"))).first()["rating"] == 5


def test_tskv_and_corpus_round_trip(spark, tmp_path):
    (tmp_path / "x.tskv").write_text("tskv\tname_ru=Кафе\ttext=one\\ntwo \\\\n\\=\trating=4\nbroken line\n")
    got = files.read_tskv(spark, str(tmp_path / "x.tskv"), ["name_ru", "text", "rating", "none"]).collect()
    assert [tuple(r) for r in got] == [("Кафе", "one\ntwo \\n=", "4", None, None), (None, None, None, None, "malformed line")]
    df = spark.createDataFrame([("1", "p", 'a "b"\nc', None)], "review_id string, place_id string, text string, city string")
    files.write_corpus(files.map_columns(df), str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), "utf-8", ",").first()
    assert back["text"] == 'a "b"\nc' and back["city"] == "" and files.sniff_delimiter("a;b\nc;d,e") == ";"


def test_store_upserts(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        Store(spark, path, read_only=True)
    s = Store(spark, path)
    s.ingest(spark.createDataFrame([("a", 1), ("b", None)], "review_id string, rating int"))
    s.ingest(spark.createDataFrame([("a", 5), ("c", 2)], "review_id string, rating int"))
    assert {tuple(r) for r in s.current().collect()} == {("a", 5), ("b", None), ("c", 2)}
    with pytest.raises(PermissionError):
        Store(spark, path, read_only=True).ingest(s.current())


def test_streamed_days_equal_batch_days(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("p", t(1, 3), 5), ("p", t(1, 9), 1), ("p", t(2, 1), 4), ("q", t(2, 2), 3)]
    for i in range(2):
        spark.createDataFrame(rows[i * 2 : i * 2 + 2], "place_id string, ts timestamp, rating int").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("place_id string, ts timestamp, rating int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    daily.upsert(daily.daily_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(90)
    got = {tuple(r) for r in daily.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {("p", dt.date(2024, 1, 1), 2, 6), ("p", dt.date(2024, 1, 2), 1, 4), ("q", dt.date(2024, 1, 2), 1, 3)}


def test_encoding_is_told_by_the_whole_file(spark, tmp_path):
    body = "id,org_id,user_id,comment\n" + "1,p,u,plain\n" * 120_000
    (tmp_path / "late.csv").write_bytes(body.encode() + "2,p,u,Вкусно\n".encode("cp1251"))
    assert files.sniff_encoding(spark, str(tmp_path / "late.csv")) == "cp1251"
    assert files.map_columns(files.read_csv(spark, str(tmp_path / "late.csv"))).where("review_id = '2'").first()["text"] == "Вкусно"
    (tmp_path / "x").write_text("tskv\ta=1\n")
    assert [files.sniff_format(spark, str(tmp_path / "x")), files.sniff_format(spark, "a.json.gz"), files.sniff_format(spark, "b.PARQUET")] == ["tskv", "jsonl", "parquet"]
    df = spark.createDataFrame([(4.7,), (2.5,)], "stars double")
    assert [r["rating"] for r in files.map_columns(df).collect()] == ["5", "2"]


def test_label_files_and_scores(spark, tmp_path):
    rows = [("r1", "Templated ", "dup?", "evaluation", "note"), ("r2", None, "duplicate", None, None)]
    labels.write_labels(spark.createDataFrame(rows, "review_id string, templated_label string, duplicate_label string, sample_type string, reviewer_notes string"), str(tmp_path / "l"))
    back = {r["review_id"]: r for r in labels.read_labels(spark, str(tmp_path / "l")).collect()}
    assert back["r1"]["templated_label"] == "templated" and back["r1"]["duplicate_label"] is None and back["r1"]["warnings"] == 1 and back["r2"]["warnings"] == 1 and back["r1"]["reviewer_notes"] == "note"
    assert labels.label_template(spark.createDataFrame([("r9",)], "review_id string")).columns == labels.LABEL_COLUMNS
    labels.write_events(spark.createDataFrame([("p", "e1", "positive")], "place_id string, event_id string, polarity string"), str(tmp_path / "e"))
    assert labels.read_events(spark, str(tmp_path / "e")).first()["polarity"] == "positive"
    chosen = spark.createDataFrame([("r1", "evaluation", "random", "p")], "review_id string, sample_type string, sampling_stratum string, place_id string")
    labels.write_selection(chosen, str(tmp_path / "s"), seed=7)
    header, entries = labels.read_selection(spark, str(tmp_path / "s"))
    assert header.first()["seed"] == 7 and entries.first()["review_id"] == "r1"
    labels.write_scores(spark.createDataFrame([("r1", 50.0)], "review_id string, templated double"), str(tmp_path / "t"), "v1")
    one = spark.createDataFrame([("r1",)], "review_id string")
    assert labels.read_scores(spark, str(tmp_path / "t"), one, "v1").count() == 1
    for reviews, mark in ((one, "v2"), (spark.createDataFrame([("r7",)], "review_id string"), "v1")):
        with pytest.raises(ValueError):
            labels.read_scores(spark, str(tmp_path / "t"), reviews, mark)


def test_annotations_are_a_log_with_a_lock(spark, tmp_path):
    store = annotations.Annotations(spark, str(tmp_path / "a"))
    row = lambda *x: spark.createDataFrame([x], "review_id string, templated_label string, sample_type string")
    assert store.status() == "OPEN" and store.current().count() == 0
    store.save(row("r1", "organic", "evaluation"))
    store.save(row("r1", "templated", "evaluation"))
    store.save(row("r2", "organic", None))
    assert {r["review_id"]: r["templated_label"] for r in store.current().collect()} == {"r1": "templated", "r2": "organic"}
    assert [r["templated_label"] for r in store.revisions().collect()] == ["organic"]
    assert {tuple(r) for r in store.progress().collect()} == {("evaluation", 1), ("unattributed", 1)}
    assert [r[0] for r in store.unlabelled(spark.createDataFrame([("r1",), ("r3",)], "review_id string")).collect()] == ["r3"]
    store.finalise("ann", "f1", "2025-01-01T00:00:00")
    with pytest.raises(annotations.BatchFinalised):
        store.save(row("r2", "templated", None))
    store.save(row("r2", "templated", None), override=True)
    with pytest.raises(annotations.FingerprintMismatch):
        store.finalise("ann", "f2", "2025-01-02T00:00:00", override=True)
    assert store.verify("f1") and store.status() == "FINALIZED"


def test_vector_cache_encodes_misses_only(spark, tmp_path):
    class Lengths:  # here, so that it reaches the workers by value
        name, dim = "lengths", 2

        def encode(self, texts):
            return [[len(t), 1.0] for t in texts]

    cache = providers.VectorCache(spark, str(tmp_path / "v"))
    df = lambda *rows: spark.createDataFrame(rows, "review_id string, text string")
    assert {tuple(map(str, r)) for r in cache.vectors(df(("a", "xy"), ("b", None)), Lengths()).collect()} == {("a", "[2.0, 1.0]")}
    assert {r["review_id"] for r in cache.vectors(df(("a", "xy"), ("c", "x")), Lengths()).collect()} == {"a", "c"}
    assert cache.store.current().count() == 2
    reader = providers.VectorCache(spark, str(tmp_path / "v"), read_only=True)
    assert reader.vectors(df(("a", "changed"),), Lengths()).first()["embedding"] == [7.0, 1.0] and cache.store.current().count() == 2
    digest = providers.content_digest(df(("a", "x"), ("b", None))).first()["digest"]
    assert providers.verify_manifest(df(("b", None), ("a", "x")), 2, digest) == [] and len(providers.verify_manifest(df(("b", "y")), 2, digest)) == 2
    assert not providers.table_exists(spark, "no_such_table")
    assert providers.FileSource().report(providers.FileSource().load(spark, str(_csv(tmp_path)))).first()[:3] == (1, 1, 0)


def _csv(folder):
    (folder / "r.csv").write_text("review_id,place_id,reviewer_id,rating,text\n1,p,u,5,good\n")
    return folder / "r.csv"
