"""Vectors that outlast a run: an append-only table by encoder and content.

Encoders of one fingerprint share a folder; a run appends one batch of the texts that
were new to it. Two runs may add the same text at the same time, with equal vectors, so
a reader keeps one of each.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.ids import content_key
from tidewire.functions.text import truncate
from tidewire.operators.embedding import Encoder, encode_column, fingerprint
from tidewire.operators.skew import few, hot_keys, skew_join
from tidewire.session import materialise
from tidewire.sources.tables import read_if_there

_SCHEMA = "content_key string, vector array<float>"


@dataclass(frozen=True)
class VectorCache:
    """The cache below one folder."""

    spark: SparkSession
    root: str

    def _path(self, encoder: Encoder) -> str:
        digest = hashlib.sha256(fingerprint(encoder).encode()).hexdigest()[:16]
        return f"{self.root.rstrip('/')}/encoder={digest}"

    def read(self, encoder: Encoder) -> DataFrame:
        """(content_key, vector) of every text that this encoder's kind has seen."""
        found = read_if_there(self.spark, self._path(encoder), _SCHEMA)
        return self.spark.createDataFrame([], _SCHEMA) if found is None else found.select("content_key", "vector")

    def add(self, encoder: Encoder, rows: DataFrame) -> DataFrame:
        """Append vectors; a text without one is left to the next run. Returns what was added."""
        path = f"{self._path(encoder)}/batch={uuid.uuid4().hex}"
        rows.where(F.col("vector").isNotNull()).write.parquet(path)
        return self.spark.read.schema(_SCHEMA).parquet(path)


def embed_cached(
    df: DataFrame, texts: dict[str, Column], encoder: Encoder, cache: VectorCache, max_chars: int | None = None
) -> DataFrame:
    """As ``embed``, but each distinct text is encoded once in the life of the cache.

    Texts meet the cache as keys; of its vectors only those asked for move, and they meet
    the rows' keys in a salted join, since a text may stand on a third of all rows.
    """
    limit, names = max_chars or encoder.max_chars, list(texts)
    told = {f"_text_{n}": truncate(c, limit) if limit else c for n, c in texts.items()}
    rows = materialise(df.withColumns(told).withColumn("_at", F.monotonically_increasing_id()))
    each = [F.struct(F.lit(n).alias("name"), content_key(F.col(f"_text_{n}")).alias("content_key"), F.col(f"_text_{n}").alias("text")) for n in names]
    long = rows.select("_at", F.inline(F.array(*each))).where(F.col("text").isNotNull())
    distinct = materialise(long.select("content_key", "text").dropDuplicates(["content_key"]))
    asked = few(distinct.select("content_key"), distinct.count())
    known = materialise(cache.read(encoder).join(asked, "content_key", "left_semi").dropDuplicates(["content_key"]))
    fresh = distinct.join(known.select("content_key"), "content_key", "left_anti")
    made = cache.add(encoder, fresh.select("content_key", encode_column(encoder, limit)(F.col("text")).alias("vector")))
    keys = long.select("_at", "name", "content_key")
    met = skew_join(keys, known.unionByName(made), "content_key", "inner", ["_at"], hot_keys(keys, "content_key"))
    of_row = met.groupBy("_at").agg(F.map_from_entries(F.collect_list(F.struct("name", "vector"))).alias("_vectors"))
    kept = [c for c in df.columns if c not in texts]
    return rows.join(of_row, "_at", "left").select(*kept, *[F.col("_vectors")[n].alias(n) for n in names])
