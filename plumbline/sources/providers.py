"""What can be plugged in: data sources and embedding providers, and the cache of vectors between them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.vectors import text_hash
from plumbline.sources.files import import_counters, normalise_rows, read_reviews
from plumbline.sources.store import Store


class DataSource(Protocol):
    """Gives normalised rows with ``reject_reason`` and ``warnings``; a bad row never fails the load."""

    def load(self, spark: SparkSession, path: str) -> DataFrame: ...


class FileSource:
    """Review files of every known shape."""

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return normalise_rows(read_reviews(spark, path))

    def report(self, rows: DataFrame) -> DataFrame:
        return import_counters(rows)


class EmbeddingProvider(Protocol):
    """Deterministic vectors of texts; ``encode`` runs in the executors, batch by batch."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encode_texts(df: DataFrame, key: str, text: str, provider: EmbeddingProvider) -> DataFrame:
    """(key, text_hash, model_name, embedding) of every row with a text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(provider.encode(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([provider.name] * batch.num_rows, pa.string()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[key, "text_hash", "model_name", "embedding"]
            )

    rows = df.where(F.col(text).isNotNull()).select(key, text_hash(F.col(text)).alias("text_hash"), text)
    return rows.mapInArrow(run, f"`{key}` {kind}, text_hash string, model_name string, embedding array<double>")


class VectorCache:
    """Vectors by (review_id, text_hash, model_name), the last write of a key counting."""

    KEY = ("review_id", "text_hash", "model_name")

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.store = Store(spark, path, self.KEY, read_only)

    def put(self, rows: DataFrame) -> None:
        """Adds vectors; nothing happens where the cache is read-only."""
        if not self.store.read_only:
            self.store.ingest(rows.select(*self.KEY, "embedding"))

    def vectors(self, rv: DataFrame, provider: EmbeddingProvider) -> DataFrame:
        """(review_id, embedding) of every review with a text: cached ones, and the missing ones encoded and kept."""
        wanted = rv.where("text IS NOT NULL").select("review_id", "text", text_hash(F.col("text")).alias("text_hash"))
        try:
            held = self.store.current().where(F.col("model_name") == provider.name).drop("model_name")
        except FileNotFoundError:
            held = None
        missing = wanted if held is None else wanted.join(held, ["review_id", "text_hash"], "left_anti")
        made = encode_texts(missing.select("review_id", "text"), "review_id", "text", provider)
        if self.store.read_only:
            hits = wanted.join(held, ["review_id", "text_hash"]).select("review_id", "embedding")
            return hits.union(made.select("review_id", "embedding"))
        self.put(made)
        return wanted.join(self.store.current().where(F.col("model_name") == provider.name), ["review_id", "text_hash"]).select("review_id", "embedding")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def content_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): the same for the same rows in any order, repeated rows included."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    word = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)"))
    x = df.agg(F.count(F.lit(1)).alias("rows"), word(1).alias("a"), word(13).alias("b"), word(25).alias("c"))
    return x.select("rows", F.sha2(F.concat_ws("|", "rows", "a", "b", "c"), 256).alias("digest"))


def verify_manifest(df: DataFrame, rows: int, digest: str) -> list[str]:
    """What differs from the manifest; empty where nothing does."""
    found = content_digest(df).first()
    return [f"{n}: {found[n]}, not {want}" for n, want in (("rows", rows), ("digest", digest)) if found[n] != want]
