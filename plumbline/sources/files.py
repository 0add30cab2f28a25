"""Reading review files of several shapes and normalising their rows; writing them back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import timeparse
from plumbline.operators import timestamps

# The column names under which each field is accepted, best first.
ALIASES = {
    "review_id": "review_id id reviewid unique_id review_uuid",
    "place_id": "place_id placeid organization_id org_id venue_id",
    "place_name": "place_name organization_name org_name vendor place",
    "place_category": "place_category category org_category business_type",
    "reviewer_id": "reviewer_id user_id reviewerid author_id account_id",
    "reviewer_name": "reviewer_name reviewer author username nickname",
    "rating": "rating score stars rating_value rate",
    "text": "text review_text review comment content feedback",
    "published_at": "published_at date date_published created_at timestamp dt",
    "city": "city town",
    "region": "region area oblast state",
    "country": "country cc",
    "latitude": "latitude lat geo_lat",
    "longitude": "longitude lon lng geo_lng",
    "source": "source data_source platform",
    "source_url": "source_url url link",
}
REQUIRED = ("review_id", "place_id", "reviewer_id")
ENCODINGS = ("utf-8", "cp1251", "latin-1")


def _head(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    """The first bytes, up to the last line feed among them; they tell the separator, not the encoding."""
    rows = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("c")).limit(1).collect()
    head = bytes(rows[0]["c"]) if rows else b""
    return head[: head.rfind(b"\n") + 1] or head


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """The first of ``ENCODINGS`` that decodes every line of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = [0] * len(ENCODINGS)
        for batch in batches:
            for line in batch.column(0).to_pylist():
                raw = line.encode("latin-1")
                for i, name in enumerate(ENCODINGS):
                    try:
                        raw.decode(name)
                        break
                    except UnicodeDecodeError:
                        bad[i] = 1
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()) for b in bad], names=[f"e{i}" for i in range(len(ENCODINGS))])

    lines = spark.read.option("encoding", "ISO-8859-1").option("header", False).option("sep", "\x01").option("quote", "").option("lineSep", "\n").schema("value string").csv(path)
    failed = lines.where("value IS NOT NULL").mapInArrow(run, ", ".join(f"e{i} int" for i in range(len(ENCODINGS)))).agg(*[F.max(f"e{i}") for i in range(len(ENCODINGS))]).first()
    return next(name for name, f in zip(ENCODINGS, failed, strict=True) if not f)


def sniff_delimiter(text: str) -> str:
    """The one of tab, comma, semicolon and bar that the first five lines have most often."""
    lines = "\n".join(text.splitlines()[:5])
    return max("\t,;|", key=lines.count)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None) -> DataFrame:
    """All columns as text, blanks kept as empty strings; quoted fields may hold line breaks."""
    head = _head(spark, path)
    encoding = encoding or sniff_encoding(spark, path)
    separator = separator or sniff_delimiter(head.decode(encoding, "replace"))
    one_byte = encoding not in ("utf-8", "utf-16", "utf-32")
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', sep=separator, encoding="ISO-8859-1" if one_byte else encoding, nullValue="\x00", emptyValue="")
    if one_byte and encoding != "latin-1":  # Spark reads few charsets; the bytes are translated after the scan
        high = bytes(range(128, 256))
        there, here = high.decode("latin-1"), "".join(b.to_bytes().decode(encoding, "ignore") or chr(b) for b in high)
        df = df.select(*[F.translate(f"`{c}`", there, here).alias(c.translate(str.maketrans(there, here))) for c in df.columns])
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A document that is an array of objects, an object with ``reviews``, or an object of objects by id.

    One row per object with text columns; entries that are no objects are dropped. Of records with one
    ``review_id`` or ``id`` the first of the document counts.
    """
    doc = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("d"))
    kind = T.ArrayType(T.StringType())
    inner = F.when(F.col("d").startswith("["), F.col("d")).otherwise(F.get_json_object("d", "$.reviews"))
    many = F.from_json(inner, kind)
    mapped = F.map_values(F.from_json("d", T.MapType(T.StringType(), T.StringType())))
    items = doc.select(F.posexplode(F.when(inner.isNotNull(), many).otherwise(mapped)).alias("pos", "o")).where(F.col("o").startswith("{"))
    records = items.select("pos", F.from_json("o", T.MapType(T.StringType(), T.StringType())).alias("m"))
    named = F.transform(F.map_entries("m"), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v")))
    _has = lambda name: F.exists("e", lambda x: x["k"] == name)
    pick = lambda name: F.element_at(F.filter("e", lambda x: x["k"] == name), 1)["v"]
    rows = records.select("pos", named.alias("e")).select(
        "pos", *[F.coalesce(*[F.when(_has(a), pick(a)) for a in v.split()]).alias(f) for f, v in ALIASES.items()]
    )
    own = F.coalesce("review_id", F.concat(F.lit("\x00"), "pos"))
    first = rows.groupBy(own.alias("rid")).agg(F.min_by(F.struct(*ALIASES), "pos").alias("m"))
    return first.select("m.*")


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", "=": "="}


def unescape_tskv(value: str) -> str:
    out, rest = [], iter(value)
    for c in rest:
        if c == "\\":
            following = next(rest, "")
            out.append(_ESCAPES.get(following, c + following))
        else:
            out.append(c)
    return "".join(out)


def read_tskv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Lines of ``tskv<tab>key=value...`` with backslash escapes, and ``reject_reason``: null for a readable line,
    else ``malformed line``, the fields being null then. Empty lines give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[dict, str | None]] = []
            for line in batch.column(0).to_pylist():
                parts = [p for p in line.split("\t") if p and p.strip() != "tskv"]
                if parts and all("=" in p for p in parts):
                    rows.append(({k.strip(): unescape_tskv(v.strip()) for k, v in (p.split("=", 1) for p in parts)}, None))
                elif line.strip():
                    rows.append(({}, "malformed line"))
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r, _ in rows], pa.string()) for f in fields] + [pa.array([w for _, w in rows], pa.string())], names=[*fields, "reject_reason"])

    return spark.read.text(path).mapInArrow(run, ", ".join(f"`{f}` string" for f in [*fields, "reject_reason"]))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .json as a document, .jsonl and .json.gz by lines, .parquet, else CSV."""
    name = path.lower()
    if name.endswith((".jsonl", ".jsonl.gz", ".json.gz")):
        return spark.read.json(path)
    if name.endswith(".json"):
        return read_json(spark, path)
    return spark.read.parquet(path) if name.endswith(".parquet") else read_csv(spark, path)


def sniff_format(spark: SparkSession, path: str) -> str:
    """parquet, tskv, jsonl, json or csv, by suffix and else by the first bytes; .gz and .bz2 are looked through."""
    name = path.lower().removesuffix(".gz").removesuffix(".bz2")
    for suffix, kind in ((".parquet", "parquet"), (".tskv", "tskv"), (".jsonl", "jsonl"), (".json", "json"), (".csv", "csv")):
        if name.endswith(suffix):
            return "jsonl" if suffix == ".json" and path.lower().endswith(".gz") else kind
    rows = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 64).alias("c")).limit(1).collect()
    head = bytes(rows[0]["c"]) if rows else b""
    if head.startswith(b"PAR1"):
        return "parquet"
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return "tskv" if line.startswith("tskv\t") else "jsonl" if line.lstrip().startswith("{") else "json" if line.lstrip().startswith("[") else "csv"


def whole_number(value: Column, kind: str) -> Column:
    """A rating as a whole number: of a text the first one, of a double the nearest (halves to even), of a boolean none."""
    if kind == "boolean":
        return F.lit(None).cast("int")
    return F.bround(value).cast("int") if kind in ("double", "float") else F.nullif(F.regexp_extract(value.cast("string"), r"-?\d+", 0), F.lit("")).try_cast("int")


def map_columns(df: DataFrame) -> DataFrame:
    """The sixteen fields as text from whatever columns there are; a missing field is null, unknown columns go."""
    there = {c.strip().lower(): c for c in reversed(df.columns)}
    picked = {f: next((there[a] for a in v.split() if a in there), None) for f, v in ALIASES.items()}
    kinds = dict(df.dtypes)
    value = lambda f, c: whole_number(F.col(f"`{c}`"), kinds[c]) if f == "rating" and kinds[c] in ("double", "float", "boolean") else F.col(f"`{c}`")
    return df.select(*[(value(f, c).cast("string") if c else F.lit(None).cast("string")).alias(f) for f, c in picked.items()])


def normalise_rows(df: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Typed rows with ``reject_reason`` (the first missing key, else null) and ``warnings``.

    Ratings take their first whole number, 1 to 5, else null and a warning; decimal commas and blanks in
    coordinates are accepted, values out of range are null with a warning; readable dates get the
    canonical UTC form, others stay as written with a warning; blank texts are null with a warning.
    """
    raw = map_columns(df)
    clean = raw.select(*[F.nullif(timeparse.strip(F.col(c)), F.lit("")).alias(c) for c in ALIASES])
    dated = timestamps.with_instants(clean, sources)
    number = lambda c: F.regexp_replace(F.regexp_replace(c, timeparse.SPACE, ""), ",", ".")

    def degrees(name: str, most: int) -> Column:
        x = F.when(number(F.col(name)).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number(F.col(name)).try_cast("double"))
        return F.when(x.between(-most, most), x)

    stars = F.nullif(F.regexp_extract("rating", r"-?\d+", 0), F.lit("")).try_cast("int")
    stars = F.when(stars.between(1, 5), stars)
    missing = F.lit(None).cast("string")
    for key in reversed(REQUIRED):
        missing = F.when(F.col(key).isNull(), F.lit(f"missing required key '{key}'")).otherwise(missing)
    warn = F.array_compact(F.array(
        F.when(F.col("rating").isNotNull() & stars.isNull(), F.lit("rating")),
        F.when(F.col("published_at").isNotNull() & F.col("instant_us").isNull(), F.lit("published_at")),
        F.when((F.col("latitude").isNotNull() & degrees("latitude", 90).isNull()) | (F.col("longitude").isNotNull() & degrees("longitude", 180).isNull()), F.lit("coordinates")),
        F.when(F.col("text").isNull(), F.lit("text")),
    ))
    typed = {
        "rating": stars, "latitude": degrees("latitude", 90), "longitude": degrees("longitude", 180),
        "published_at": F.coalesce(timestamps.utc_text(F.col("instant_us")), F.col("published_at")),
    }
    return dated.select(*[typed.get(c, F.col(c)).alias(c) for c in ALIASES], missing.alias("reject_reason"), warn.alias("warnings"))


def import_counters(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("valid"), F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
    )


def write_corpus(df: DataFrame, path: str) -> None:
    """CSV in the fixed column order, null as empty."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ALIASES]).write.csv(path, header=True, escape='"', quoteAll=True, mode="overwrite")
