"""Requests to ranked, enriched recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.portfolio import with_portfolio_text
from tidewire.functions.text import user_query_text
from tidewire.operators import ranking
from tidewire.operators.embedding import Encoder, encode_column
from tidewire.operators.filters import split_blank
from tidewire.operators.scorer import Scorer
from tidewire.operators.search import fusion_topk
from tidewire.session import materialise

REQUEST_COLUMNS = ["request_id", "categories", "days", "as_of_ms", "use_latest"]


def candidates(
    requests: DataFrame,
    vectors: DataFrame,
    k: int = ranking.RESULTS,
    rrf_k: int = 2,
    rank_base: int = 0,
    filter_latest: bool = False,
) -> DataFrame:
    """Fused hits of the searching requests, the newest articles for the others."""
    searching = requests.where(~F.coalesce(F.col("use_latest"), F.lit(False)))
    fused = fusion_topk(searching, vectors, k, rrf_k, rank_base)
    newest = ranking.latest_candidates(requests, vectors, apply_filters=filter_latest)
    columns = ["request_id", "article_id", "retrieval_score", "retrieval_rank"]
    return fused.select(columns).unionByName(newest.select(columns))


def recommend(
    requests: DataFrame,
    vectors: DataFrame,
    articles: DataFrame,
    scorer: Scorer,
    k: int = ranking.RESULTS,
    blend_on: str = "fused",
    **search,
) -> DataFrame:
    """Recommendations of requests that already carry a ``query_vec``.

    The candidates are few and narrow but costly, so they are kept once in the
    shared folder: a lost executor then repeats the ranking and not the search.
    The articles that very many requests share are counted on the kept rows.
    """
    found = materialise(candidates(requests, vectors, **search))
    wanted = ranking.Wanted.of(found)
    ranked = ranking.score_and_rank(found, requests, vectors, scorer, wanted, k, blend_on).select(
        "request_id", "rank", "article_id", "score"
    )
    return ranking.enrich(ranked, vectors, articles, wanted, ["request_id"])


def context_requests(requests: DataFrame, encoder: Encoder) -> DataFrame:
    """Requests with clicked text and interests, embedded as one query."""
    asked = requests.withColumn(
        "query_text",
        user_query_text(F.col("clicked_news"), F.col("interests"), F.col("categories")),
    )
    return _encoded(asked, encoder)


def portfolio_requests(requests: DataFrame, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """Requests with a portfolio document, embedded; and those without content."""
    accepted, rejected = split_blank(with_portfolio_text(requests), "query_text")
    return _encoded(accepted, encoder), rejected


def _encoded(asked: DataFrame, encoder: Encoder) -> DataFrame:
    encode = encode_column(encoder)
    return materialise(
        asked.select(*REQUEST_COLUMNS, encode(F.col("query_text")).alias("query_vec"))
    )


def recommend_from_context(
    requests: DataFrame,
    vectors: DataFrame,
    articles: DataFrame,
    encoder: Encoder,
    scorer: Scorer,
    k: int = ranking.RESULTS,
    **search,
) -> DataFrame:
    return recommend(context_requests(requests, encoder), vectors, articles, scorer, k, **search)


def recommend_from_portfolio(
    requests: DataFrame,
    vectors: DataFrame,
    articles: DataFrame,
    encoder: Encoder,
    scorer: Scorer,
    k: int = ranking.RESULTS,
    **search,
) -> tuple[DataFrame, DataFrame]:
    """Recommendations, and the rejected requests with their reason."""
    accepted, rejected = portfolio_requests(requests, encoder)
    return recommend(accepted, vectors, articles, scorer, k, **search), rejected


def latest_feed(vectors: DataFrame, articles: DataFrame, n: int = ranking.RESULTS) -> DataFrame:
    """The newest n articles, score one, enriched.

    The n ids are few by definition; they are broadcast to the article scan.
    """
    newest = ranking.latest(vectors, n).select(
        F.lit("anonymous").alias("user_id"),
        "article_id",
        "title",
        "summary",
        F.col("tags").alias("category"),
        "timestamp",
        F.lit(1.0).alias("score"),
    )
    bodies = articles.join(
        F.broadcast(newest.select(F.col("article_id").alias("id"))), "id", "left_semi"
    ).select(F.col("id").alias("article_id"), F.struct(*articles.columns).alias("full_article"))
    fa = F.col("full_article")
    stamp = fa["published_time_unix"]

    def filled(name: str, full: str):
        return F.coalesce(F.when(F.col(name) != "", F.col(name)), fa[full], F.lit(""))

    return newest.join(bodies, "article_id", "left").select(
        "user_id",
        "article_id",
        filled("title", "title").alias("title"),
        filled("summary", "introductory_paragraph").alias("summary"),
        F.coalesce("category", F.array().cast("array<string>")).alias("category"),
        F.coalesce("timestamp", F.when(stamp != 0, stamp)).alias("timestamp"),
        "score",
        fa,
    )
