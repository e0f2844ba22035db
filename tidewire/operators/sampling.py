"""Reproducible sampling and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.ids import seeded_long, seeded_order
from tidewire.session import materialise

TRIES = 15
_PLACE_BITS = 33


def random_cap(df: DataFrame, key: str, n: int | None, seed: int) -> DataFrame:
    """A random n rows that depend on seed and key only; None keeps all."""
    return df if n is None else df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows 0, 1, 2, … in the given order without one global sort task.

    Rows are range-partitioned and sorted; each gets its place in its partition;
    the offsets are a running sum over one row per partition. The placed rows are
    kept in the shared folder, as range bounds are drawn by sampling and a second
    evaluation could draw others.
    """
    placed = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    partition = F.shiftright("_at", _PLACE_BITS).alias("_partition")
    sizes = placed.groupBy(partition).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_partition", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        placed.withColumn("_partition", F.shiftright("_at", _PLACE_BITS))
        .join(F.broadcast(offsets), "_partition")
        .withColumn(name, F.col("_offset") + place)
        .drop("_at", "_partition", "_offset")
    )


def training_pairs(indexed: DataFrame, n_articles: int, n_pairs: int, seed: int) -> DataFrame:
    """Alternate a positive (an article with itself) and a negative pair.

    ``indexed`` has ``idx`` from 0, ``article_id`` and ``tags``. A negative is the
    first of fifteen random articles that shares no tag with the anchor. When
    none does, or the anchor has no tags, it is a random other article. All draws
    come from a hash of seed, pair and try. The joins are on the drawn index,
    which is uniform, and never on tags.
    """
    if n_articles < 2:
        raise ValueError("training pairs need at least two articles")
    spark = indexed.sparkSession
    n = F.lit(n_articles).cast("bigint")
    pair = F.col("pair")
    anchors = spark.range((n_pairs + 1) // 2).select(
        F.col("id").alias("pair"), (seeded_long(seed, F.lit("anchor"), F.col("id")) % n).alias("idx")
    )
    known = indexed.select("idx", "article_id", "tags")
    anchored = anchors.join(known, "idx").select(
        "pair",
        F.col("idx").alias("anchor_idx"),
        F.col("article_id").alias("anchor_id"),
        F.col("tags").alias("anchor_tags"),
    )
    tries = F.explode(F.sequence(F.lit(1), F.lit(TRIES))).alias("try")
    drawn = (
        anchored.where(F.size("anchor_tags") > 0)
        .select("pair", "anchor_tags", tries)
        .withColumn("idx", seeded_long(seed, F.lit("try"), pair, F.col("try")) % n)
    )
    apart = ~F.arrays_overlap("anchor_tags", F.coalesce("tags", F.array().cast("array<string>")))
    first = (
        drawn.join(known, "idx")
        .where(apart)
        .groupBy("pair")
        .agg(F.min(F.struct("try", "article_id"))["article_id"].alias("found_id"))
    )
    step = seeded_long(seed, F.lit("other"), pair) % (n - 1)
    fallback = anchored.select(
        "*", ((F.col("anchor_idx") + 1 + step) % n).alias("idx")
    ).join(known.select("idx", F.col("article_id").alias("other_id")), "idx")
    both = fallback.join(first, "pair", "left").select(
        "pair", "anchor_id", F.coalesce("found_id", "other_id").alias("negative_id")
    )
    labelled = F.explode(
        F.array(
            F.struct((pair * 2).alias("pair_id"), F.col("anchor_id").alias("news_id"), F.lit(1.0).alias("label")),
            F.struct((pair * 2 + 1).alias("pair_id"), F.col("negative_id").alias("news_id"), F.lit(0.0).alias("label")),
        )
    )
    return (
        both.select(F.col("anchor_id").alias("user_id"), labelled.alias("p"))
        .select("p.pair_id", "user_id", "p.news_id", "p.label")
        .where(F.col("pair_id") < n_pairs)
    )
