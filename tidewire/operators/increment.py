"""What is new: idempotence, last write wins, and the cap per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.skew import sized


def presence(ids: DataFrame, articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, in_articles, in_vectors) of those of the given ids that a store holds.

    Each store gives its id column, once. Ids that the caller has marked for broadcast
    go to both scans, which then are not shuffled.
    """
    yes, no = F.lit(True), F.lit(False)
    held = articles.select("id", yes.alias("in_articles"), no.alias("in_vectors")).union(
        vectors.select(F.col("article_id").alias("id"), no, yes)
    )
    found = held.join(ids.select("id"), "id", "left_semi").groupBy("id")
    return found.agg(F.max("in_articles").alias("in_articles"), F.max("in_vectors").alias("in_vectors"))


def present_in_both(ids: DataFrame, articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Which of the given ids both stores hold.

    Half-written ones are not among them.
    """
    asked = sized(ids.select("id").distinct())
    return presence(asked, articles, vectors).where("in_articles and in_vectors").select("id")


def not_in_both(incoming: DataFrame, articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows whose id is missing from either store; a half-written one comes again."""
    both = sized(present_in_both(incoming, articles, vectors))
    return incoming.join(both, "id", "left_anti")


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key. The group limit runs before the shuffle as well, so
    each task sends at most one row per key, however often a key repeats."""
    last_first = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_place", F.row_number().over(last_first)).where("_place = 1").drop("_place")


def cap_new(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """At most so many new rows per run, in source order; None takes all."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def newer_than(df: DataFrame, mark: int, limit: int | None = None, inclusive: bool = False) -> DataFrame:
    """Rows past the mark, oldest first by number; the filter reaches the scan."""
    stamp = F.col("published_time_unix")
    newer = df.where(stamp >= mark if inclusive else stamp > mark)
    return newer if limit is None else newer.orderBy(stamp.asc(), "id").limit(limit)


def oldest_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.col("published_time_unix").asc(), "id")
    return ordered if limit is None else ordered.limit(limit)
