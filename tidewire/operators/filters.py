"""Row predicates of requests and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import strip_space
from tidewire.functions.times import recency_cutoff


def has_any_tag(tags: Column, categories: Column) -> Column:
    """Any shared tag; no categories means no filter."""
    asked = F.coalesce(categories, F.array().cast("array<string>"))
    shared = F.coalesce(F.arrays_overlap(tags, asked), F.lit(False))
    return (F.size(asked) == 0) | shared


def is_recent(timestamp: Column, days: Column, as_of_ms: Column) -> Column:
    """No older than the days asked for; an article without a stamp fails."""
    cutoff = recency_cutoff(as_of_ms, days)
    return cutoff.isNull() | F.coalesce(timestamp >= cutoff, F.lit(False))


def passes(tags: Column, timestamp: Column, categories: Column, days: Column, as_of_ms: Column) -> Column:
    return has_any_tag(tags, categories) & is_recent(timestamp, days, as_of_ms)


def by_id(articles: DataFrame, article_id: str) -> DataFrame:
    return articles.where(F.col("id") == article_id).limit(1)


def by_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles whose id is listed; ids that match nothing leave no row."""
    return articles.join(ids.select("id"), "id", "left_semi")


def split_blank(requests: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Requests with text to search for, and the rejected rest with a reason."""
    blank = strip_space(F.coalesce(F.col(text), F.lit(""))) == ""
    rejected = requests.where(blank).withColumn("reason", F.lit("no content to search for"))
    return requests.where(~blank), rejected
