"""Articles to vector rows."""

from __future__ import annotations

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.functions.ids import point_id
from tidewire.operators.embedding import Encoder, embed
from tidewire.schemas import VECTOR_COLUMNS, VECTORS
from tidewire.sources.vector_cache import VectorCache, embed_cached

#: A whole article, carried beside the vectors that are made of it.
ARTICLE_OF_ROW = "_article"


def vector_rows(rows: DataFrame) -> DataFrame:
    """Every column of the vector table, absent ones as null.

    A missing named vector takes the common one, ``vector``, if there is one. The
    article that a row was made of stays beside it, if it came along.
    """
    def column(field):
        if field.name in VECTOR_COLUMNS and "vector" in rows.columns:
            own = [F.col(field.name)] if field.name in rows.columns else []
            return F.coalesce(*own, F.col("vector")).cast(field.dataType)
        if field.name in rows.columns:
            return F.col(field.name).cast(field.dataType)
        return F.lit(None).cast(field.dataType)

    return rows.select(*[column(f).alias(f.name) for f in VECTORS], *_along(rows))


def _along(rows: DataFrame) -> list[str]:
    return [ARTICLE_OF_ROW] if ARTICLE_OF_ROW in rows.columns else []


def _light(articles: DataFrame, *extra) -> DataFrame:
    return articles.select(
        F.col("id").alias("article_id"),
        point_id(F.col("id")).alias("point_id"),
        "title",
        text.summary(F.col("introductory_paragraph")).alias("summary"),
        text.parse_tags(F.col("tags")).alias("tags"),
        F.col("published_time_unix").alias("timestamp"),
        "published_time",
        *extra,
        *_along(articles),
    )


def encoded(
    rows: DataFrame, texts: dict[str, Column], encoder: Encoder, max_chars: int | None = None,
    seen: Accumulator | None = None, cache: VectorCache | None = None,
) -> DataFrame:
    """Vectors of the texts, from the cache where there is one."""
    if cache is None:
        return embed(rows, texts, encoder, max_chars, seen)
    return embed_cached(rows, texts, encoder, cache, max_chars)


def named_vectors(
    articles: DataFrame, encoder: Encoder, seen: Accumulator | None = None, cache: VectorCache | None = None
) -> DataFrame:
    """Title, introduction and tags embedded apart."""
    rows = _light(articles, F.col("introductory_paragraph").alias("intro"))
    texts = {
        "title_vec": F.col("title"),
        "description_vec": F.col("intro"),
        "tags_vec": text.tags_as_text(F.col("tags")),
    }
    return vector_rows(encoded(rows, texts, encoder, seen=seen, cache=cache))


def common_vector(
    articles: DataFrame, encoder: Encoder, seen: Accumulator | None = None, cache: VectorCache | None = None
) -> DataFrame:
    """One vector of title and introduction, used under all three names."""
    whole = text.news_embedding_text(F.col("title"), F.col("introductory_paragraph"))
    rows = _light(articles, whole.alias("whole"))
    return vector_rows(encoded(rows, {"vector": F.col("whole")}, encoder, seen=seen, cache=cache))
