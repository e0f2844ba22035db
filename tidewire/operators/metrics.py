"""Counts and summaries over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import VECTOR_COLUMNS


def max_published(articles: DataFrame) -> DataFrame:
    """The newest publish time; null when there is none."""
    return articles.agg(F.max("published_time_unix").alias("max_published"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Points, and vectors per named field."""
    per_field = [F.count(c).alias(f"{c}_count") for c in VECTOR_COLUMNS]
    return vectors.agg(F.count("*").alias("points_count"), *per_field)


def tag_index(tagged: DataFrame) -> DataFrame:
    """Tag to article, one row per pair: an inverted index without giant lists."""
    return tagged.select(F.explode(F.array_distinct("tags")).alias("tag"), "article_id")


def tag_counts(tagged: DataFrame) -> DataFrame:
    """Articles per tag, combined before the shuffle."""
    return tag_index(tagged).groupBy("tag").agg(F.count("*").alias("articles"))


def run_metrics(outcomes: DataFrame) -> DataFrame:
    """Totals of a run from rows that carry an ``outcome``.

    An outcome is ``ingested``, ``skipped`` or ``error``; anything else remains.
    """
    def tally(name: str):
        return F.coalesce(F.sum((F.col("outcome") == name).cast("bigint")), F.lit(0))

    ingested, skipped, errors = tally("ingested"), tally("skipped"), tally("error")
    total = F.count("*")
    done = F.round(100.0 * (ingested + skipped) / F.greatest(total, F.lit(1)), 1)
    return outcomes.agg(
        total.alias("total"),
        ingested.alias("ingested"),
        skipped.alias("skipped"),
        errors.alias("errors"),
        (total - ingested - skipped - errors).alias("remaining"),
        done.alias("percent_done"),
    )


def feed_view(results: DataFrame) -> DataFrame:
    """Result items as the feed shows them."""
    from tidewire.functions.scoring import match_percent
    from tidewire.functions.times import display_date, feed_summary, feed_title

    fa = F.col("full_article")
    return results.select(
        *[c for c in ("request_id", "rank") if c in results.columns],
        "article_id",
        feed_title(F.col("title"), fa["title"]).alias("title"),
        feed_summary(F.col("summary"), fa["introductory_paragraph"]).alias("summary"),
        F.slice("category", 1, 3).alias("categories"),
        display_date(
            F.col("timestamp"), fa["published_time_unix"], fa["published_time"]
        ).alias("display_date"),
        match_percent(F.col("score")).alias("match_percent"),
    )
