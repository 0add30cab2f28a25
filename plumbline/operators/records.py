"""Splitting raw delimited records into typed rows and rows that fail to parse, with the reason.

The tokenizer is a finite-state machine over characters. A batch of records is one stream, cut into
equal chunks without regard to records: for every chunk the machine runs from every state at once, the
chunks' state maps are composed by a prefix scan, and a second run from the now known states marks
fields and errors. Long records and short ones so cost the same per character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import timeparse

START, PLAIN, QUOTED, CLOSED, BAD = range(5)
OTHER, QUOTE, SEPARATOR, BOUNDARY = range(4)
# next state by [character class, state]
STEP = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BAD, BAD],
        [QUOTED, BAD, CLOSED, QUOTED, BAD],
        [START, START, QUOTED, START, BAD],
        [START, START, START, START, START],
    ],
    dtype=np.int8,
)
CHUNK = 256


def states_after(classes: np.ndarray) -> np.ndarray:
    """The state after each character of a stream that begins in START."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int8)
    grid = np.full(-(-n // CHUNK) * CHUNK, BOUNDARY, np.int8)
    grid[:n] = classes
    grid = grid.reshape(-1, CHUNK).T.copy()
    maps = np.tile(np.arange(5, dtype=np.int8), (grid.shape[1], 1))
    for row in grid:
        maps = STEP[row[:, None], maps]
    hop = 1
    while hop < len(maps):  # inclusive scan: maps[i] becomes the map of chunks 0..i
        maps[hop:] = np.take_along_axis(maps[hop:], maps[:-hop], axis=1)
        hop *= 2
    now = np.r_[np.int8(START), maps[:-1, START]]
    out = np.empty_like(grid)
    for i, row in enumerate(grid):
        now = STEP[row, now]
        out[i] = now
    return out.T.ravel()[:n]


def tokenize(lines: list[str | None], separators: list[str | None]) -> tuple[list[list[str] | None], list[int | None]]:
    """Fields of each record, or None and the offset of the character that breaks the quoting."""
    texts = [x or "" for x in lines]
    sizes = np.array([len(x) for x in texts], np.int64)
    stream = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    seps = np.array([ord(s) if s and len(s) == 1 else 0x10FFFF for s in separators], np.uint32)
    classes = np.zeros(len(stream), np.int8)
    classes[stream == ord('"')] = QUOTE
    classes[stream == np.repeat(seps, sizes + 1)] = SEPARATOR
    classes[ends] = BOUNDARY
    state = states_after(classes)
    before_end = np.where(sizes > 0, state[np.maximum(ends - 1, 0)], START)
    cuts = np.flatnonzero((state == START) & (classes == SEPARATOR))
    lo, hi = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
    fields: list[list[str] | None] = []
    errors: list[int | None] = []
    for i, text in enumerate(texts):
        a, b = int(starts[i]), int(ends[i])
        if before_end[i] in (BAD, QUOTED):
            own = state[a:b]
            opened = np.flatnonzero((own == QUOTED) & (np.r_[np.int8(START), own[:-1]] == START)) if before_end[i] == QUOTED else None
            errors.append(int(np.argmax(own == BAD)) if opened is None else int(opened[-1]))
            fields.append(None)
            continue
        edges = [-1, *(cuts[lo[i] : hi[i]] - a).tolist(), b - a]
        row = [text[x + 1 : y] for x, y in zip(edges, edges[1:], strict=False)]
        fields.append([f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in row])
        errors.append(None)
    return fields, errors


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields, errors = tokenize(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fields, pa.list_(pa.string())), pa.array(errors, pa.int32())], names=["k", "f", "e"]
        )


def _blank(c: Column) -> Column:
    return F.coalesce(timeparse.strip(c) == "", F.lit(True))


LATITUDE = r"^[+-]?\d+(\.\d+)?$"


def _number(c: Column) -> Column:
    """Text of a decimal: white space removed, commas as points."""
    return F.regexp_replace(F.regexp_replace(c, timeparse.SPACE, ""), ",", ".")


def parse_records(
    df: DataFrame,
    fields: list[str],
    key: str = "line_id",
    raw: str = "raw_line",
    separator: str = "field_sep",
    required: tuple[str, ...] = ("review_id", "place_id", "reviewer_id"),
) -> DataFrame:
    """One row per record: key, ``reason``, ``error_offset``, ``error_field`` and the typed ``fields``.

    ``reason`` is null for a valid record, else the first of ``quoting``, ``columns``, ``key``,
    ``rating``, ``latitude`` that applies; ``error_offset`` is the character at which the quoting
    breaks (an open field: its opening quote), ``error_field`` the 1-based field for the later reasons.
    Failed records keep null fields. A null or empty record is one blank field (``columns``). A separator
    that is null, empty or longer than one character never occurs in a record. Valid rows have blank
    strings as null, ``rating`` as int (its first whole number), ``latitude`` and ``longitude`` as
    double (longitude: null when unreadable or outside -180..180) and every other field as stripped
    text. Rows with a null key are kept. Rows are independent: no shuffle.
    """
    kind = df.schema[key].dataType
    cut = df.select(F.col(key).alias("k"), F.col(raw).alias("r"), F.col(separator).alias("s")).mapInArrow(
        _tokenized,
        T.StructType([
            T.StructField("k", kind),
            T.StructField("f", T.ArrayType(T.StringType())),
            T.StructField("e", T.IntegerType()),
        ]),
    )
    at = {name: F.get("f", F.lit(i)) for i, name in enumerate(fields)}
    whole = F.size("f") == len(fields)
    rating = F.regexp_extract(at["rating"], r"-?\d+", 0)
    stars = rating.try_cast("int")
    lat = _number(at["latitude"])
    degrees = F.when(lat.rlike(LATITUDE), lat.try_cast("double"))
    missing = F.lit(None).cast("int")
    for name in reversed(required):
        missing = F.when(_blank(at[name]), fields.index(name) + 1).otherwise(missing)
    reason = (
        F.when(F.col("e").isNotNull(), "quoting")
        .when(~whole, "columns")
        .when(missing.isNotNull(), "key")
        .when(~_blank(at["rating"]) & ~F.coalesce(stars.between(1, 5), F.lit(False)), "rating")
        .when(~_blank(at["latitude"]) & ~F.coalesce(degrees.between(-90, 90), F.lit(False)), "latitude")
    )
    checked = cut.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    lon = _number(at["longitude"]).try_cast("double") if "longitude" in at else F.lit(None)
    typed = {"rating": stars, "latitude": degrees, "longitude": F.when(lon.between(-180, 180), lon)}
    return checked.select(
        F.col("k").alias(key),
        "reason",
        F.col("e").alias("error_offset"),
        F.when(F.col("reason") == "key", missing)
        .when(F.col("reason") == "rating", fields.index("rating") + 1)
        .when(F.col("reason") == "latitude", fields.index("latitude") + 1)
        .alias("error_field"),
        *[
            F.when(ok, typed[name] if name in typed else F.nullif(timeparse.strip(at[name]), F.lit(""))).alias(name)
            for name in fields
            if name != key
        ],
    )
