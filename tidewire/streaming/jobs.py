"""Streaming ingest of hourly files and of a CSV drop folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions import text
from tidewire.functions.ids import point_id
from tidewire.operators.embedding import HOURLY_CHARS, Encoder
from tidewire.operators.increment import keep_last
from tidewire.operators.normalise import hourly_items, hourly_parsed
from tidewire.plans.embed import common_vector, encoded, vector_rows
from tidewire.plans.ingest import ingest
from tidewire.schemas import ARTICLE_COLUMNS
from tidewire.session import materialise
from tidewire.sources import readers
from tidewire.sources.tables import Store
from tidewire.sources.vector_cache import VectorCache

HOURLY = "1 hour"
#: Dropped files whose names one batch takes to the driver.
FILES_A_BATCH = 1000


def _start(stream: DataFrame, each, checkpoint: str, every: str | None) -> StreamingQuery:
    """Run once over everything unseen, or keep on at an interval."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def query_id(store: Store, checkpoint: str) -> str:
    """The id of the streaming query that a checkpoint folder belongs to."""
    told = store.spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(told)["id"]


def hourly_vectors(parsed: DataFrame, encoder: Encoder, cache: VectorCache | None = None) -> DataFrame:
    """Vector rows of parsed hourly articles, every payload column filled."""
    # Of a repeated id the last in source order counts: a later file corrects.
    items = keep_last(hourly_items(parsed), "article_id", "_file", "_at").drop("_file", "_at")
    limit = min(HOURLY_CHARS, encoder.max_chars) if encoder.max_chars else None

    def cleaned(c):
        return text.strip_space(c)

    vectors = encoded(
        items.withColumn("point_id", point_id(F.col("article_id"))),
        {
            "title_vec": cleaned(F.col("title")),
            "description_vec": cleaned(F.col("description")),
            "tags_vec": cleaned(text.tags_as_text(F.col("tags"))),
        },
        encoder,
        limit,
        cache=cache,
    )
    return vector_rows(vectors.withColumn("summary", text.summary(F.col("description"))))


def stream_hourly(
    store: Store,
    path: str,
    encoder: Encoder,
    checkpoint: str,
    every: str | None = None,
    files_per_batch: int | None = None,
    cache: VectorCache | None = None,
) -> StreamingQuery:
    """Every hourly file that has not been seen, to the vector table.

    A batch that comes again after a failure has the number it had before in its query,
    which the run table knows, so it is written once.
    """
    source = f"hourly:{path}"

    def each(files: DataFrame, epoch: int) -> None:
        # A file is opened once: what it lists, and what is refused, come from the kept rows.
        files = materialise(files)
        listed = F.col("articles").isNotNull()
        unreadable = files.where(~listed & F.col(readers.CORRUPT).isNotNull()).select(
            F.col("file").alias("id"),
            F.lit("unreadable record").alias("reason"),
            F.col(readers.CORRUPT).alias("record"),
        )
        parsed, malformed = hourly_parsed(files.where(listed))
        unreadable = unreadable.unionByName(malformed)
        vectors = hourly_vectors(parsed, store.bind(encoder), cache)
        store.upsert_vectors(vectors, source, None, epoch, unreadable, query_id(store, checkpoint))

    stream = readers.hourly_stream(store.spark, path, files_per_batch)
    return _start(stream, each, checkpoint, every)


def stream_csv(
    store: Store,
    path: str,
    encoder: Encoder,
    checkpoint: str,
    every: str | None = None,
    files_per_batch: int = FILES_A_BATCH,
    multi_line: bool = True,
    cache: VectorCache | None = None,
) -> StreamingQuery:
    """Every CSV file dropped into a folder, to both tables; progress in ``runs``.

    The stream is of file names; each file is then read by its own header, as in a
    batch. A file without the required columns is quarantined by name.
    """
    source = f"csv-drop:{path}"
    reader = store.spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    )
    reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def each(names: DataFrame, epoch: int) -> None:
        files = [r["path"] for r in names.collect()]  # the files of one batch
        if not files:
            return
        rows, refused = readers.read_dropped_csv(store.spark, files, multi_line)
        if rows is None:
            columns = [*ARTICLE_COLUMNS, readers.CORRUPT]
            rows = store.spark.createDataFrame([], ", ".join(f"{c} string" for c in [*columns, "_seq"]))
        ingest(
            store, rows, encoder, source, common_vector, epoch=epoch, query=query_id(store, checkpoint),
            refused=refused, cache=cache,
        )

    return _start(reader.load(path).select("path"), each, checkpoint, every)
