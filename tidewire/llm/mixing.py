"""Mixing sources to target weights with hash thresholds found by histograms.

A document's place is a 36-bit hash of its id. Sizes are summed by source and the
first 12 bits of the place; the bucket in which a source's budget runs out is the only
one refined, by the next 12 bits, and once more by the last 12. What lies below the
threshold found so is taken: no sort, no per-source collection, and every histogram
holds at most 4096 rows a source, summed on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.words import without
from tidewire.session import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
BITS, LEVELS = 12, 3
RESULT = ["size", "source_size", "target", "taken", "copies"]


def place(row_id: Column, text: Column) -> Column:
    """36 bits of the md5 of the id, or of the text where the id is null."""
    named = F.coalesce(row_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(named), 1, BITS * LEVELS // 4), 16, 10).cast("bigint")


def _key(source: Column) -> Column:
    """Null and the empty source stay apart, and both can be joined on."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def _numbered(scratch: Scratch, totals: DataFrame) -> DataFrame:
    """Sources by code point, null last, numbered from 0 across sorted partitions."""
    order = [(F.col("_key") == ""), F.col("_key")]
    at = scratch.keep(
        totals.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_part", F.shiftright("_at", 33))
    parts = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = parts.select("_part", before.alias("_before"))
    rank = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)
    return at.join(first, "_part").select("_key", "source_size", rank.alias("_rank"))


def targets(
    scratch: Scratch, totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """One row per source with its target.

    The total is shared by weight; a source never gets more than ``most`` times its
    size, and the excess is shared again among the others until none is above. Each
    round is one sum over the sources; only three numbers reach the driver.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    weight = F.get(cycle, (F.col("_rank") % len(weights)).cast("int"))
    named = scratch.keep(
        _numbered(scratch, totals).select("_key", "source_size", weight.alias("_weight")), "weighted"
    )
    full = most * F.col("source_size")
    whole = named.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, None
    while True:
        above = F.col("_weight") * F.lit(level) > full
        held, share, n = named.agg(
            F.coalesce(F.sum(F.when(above, full)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0)),
            F.count_if(above),
        ).first()
        if n == capped or not share:
            break
        level, capped = (whole - held) / share, n
    return named.select(
        "_key", "source_size",
        F.least((F.col("_weight") * F.lit(level)), full.cast("double")).alias("target"),
    )


def thresholds(scratch: Scratch, rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole copies of everything, and the place below which one more is taken."""
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("bigint")
    found = scratch.keep(
        goals.withColumn("_whole", whole)
        .withColumn("_rest", F.greatest(target - F.col("_whole") * size, F.lit(0.0)))
        .withColumn("_below", F.lit(0).cast("bigint")),
        "level0",
    )
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright("_place", shift)
        inside = F.shiftright("_place", shift + BITS) == F.shiftright("_below", shift + BITS)
        sums = (
            rows.join(found.select("_key", "_below"), "_key").where(inside if level > 1 else F.lit(True))
            .groupBy("_key", bucket.alias("_bucket")).agg(F.sum("size").alias("_n"))
        )
        past = F.sum("_n").over(Window.partitionBy("_key").orderBy("_bucket"))
        cut = (
            sums.withColumn("_past", past).join(found.select("_key", "_rest"), "_key")
            .where(F.col("_past") > F.col("_rest"))
            .groupBy("_key").agg(F.min(F.struct("_bucket", "_past", "_n")).alias("_cut"))
        )
        cut = cut.select(
            "_key", F.shiftleft("_cut._bucket", shift).alias("_next"),
            (F.col("_cut._past") - F.col("_cut._n")).alias("_spent"), F.col("_cut._n").alias("_same"),
        )
        found = scratch.keep(
            found.join(cut, "_key", "left").select(
                "_key", "source_size", "target", "_whole",
                (F.col("_rest") - F.coalesce("_spent", F.lit(0))).alias("_rest"),
                F.coalesce("_next", "_below").alias("_below"),
                F.coalesce("_same", F.lit(0)).alias("_tied"),
            ),
            f"level{level}",
        )
    # Documents of one place are not told apart: they go in if that comes nearer.
    nearer = (F.col("_tied") > 0) & (2 * F.col("_rest") >= F.col("_tied"))
    return found.select(
        "_key", "source_size", "target", "_whole",
        (F.col("_below") + F.when(nearer, 1).otherwise(0)).alias("_below"),
    )


def mix(
    spark: SparkSession,
    docs: DataFrame,
    size: Column,
    row_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """Every row with its size, its source's size and target, and the words taken of it.

    ``taken`` is size times ``copies``, 0 to ``most``. The n-th copy of a row goes the
    way of the first, since places follow ids; null ids are placed by their text. A
    null source is a source of its own. Empty texts have size 0, and a table without
    words has targets of 0. Input columns named as a result give way to it.
    """
    scratch = Scratch(spark, "mixing")
    names = without(docs, RESULT).columns
    placed = docs.select(
        *[F.col(f"`{c}`") for c in names],
        size.cast("bigint").alias("size"),
        _key(F.col(f"`{source}`")).alias("_key"),
        place(F.col(f"`{row_id}`"), F.col(f"`{text}`") if text in docs.columns else F.lit(None)).alias("_place"),
    )
    rows = scratch.keep(placed.select("_key", "_place", "size"), "places")
    totals = rows.groupBy("_key").agg(F.sum("size").alias("source_size"))
    goals = targets(scratch, totals, weights, most)
    cuts = scratch.keep(thresholds(scratch, rows, goals), "cuts")
    scratch.drop("places", "ordered", "weighted", *[f"level{n}" for n in range(LEVELS + 1)])
    copies = F.col("_whole") + F.when(F.col("_place") < F.col("_below"), 1).otherwise(0)
    return placed.join(cuts, "_key").select(
        *[F.col(f"`{c}`") for c in names], "size", "source_size", "target",
        (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"),
    )
