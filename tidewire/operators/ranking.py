"""Candidates to a ranked, enriched list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.ids import result_id
from tidewire.functions.scoring import blend
from tidewire.functions.text import none_if_empty
from tidewire.functions.vectors import cosine, scoring_vector
from tidewire.operators.scorer import Scorer, score_candidates
from tidewire.operators.skew import hot_keys, sized, skew_join
from tidewire.schemas import VECTOR_COLUMNS

# Results per request, and candidates in the mode of newest articles.
RESULTS = 50
LATEST_CANDIDATES = 100


@dataclass(frozen=True)
class Wanted:
    """The articles that candidates name: their ids, and the hot ones among them.

    If the ids are few they are broadcast to the scans of the large tables, so
    that of vectors and bodies only the wanted rows are ever shuffled.
    """

    ids: DataFrame
    hot: DataFrame | None

    @staticmethod
    def of(candidates: DataFrame) -> Wanted:
        return Wanted(
            sized(candidates.select("article_id").distinct()), hot_keys(candidates, "article_id")
        )

    def only(self, table: DataFrame) -> DataFrame:
        return table.join(self.ids, "article_id", "left_semi")


def with_vectors(
    candidates: DataFrame, requests: DataFrame, vectors: DataFrame, width: int, wanted: Wanted
) -> DataFrame:
    """Bring each candidate its user vector and its scoring vector.

    An article may be a candidate of very many requests, so that join is salted.
    A request has a bounded number of candidates, so the other is not.
    """
    present = [F.col(c) if c in vectors.columns else F.lit(None) for c in VECTOR_COLUMNS]
    news = vectors.select("article_id", scoring_vector(*present, width).alias("news_vec"))
    users = requests.select("request_id", F.col("query_vec").alias("user_vec"))
    paired = skew_join(
        candidates, wanted.only(news), "article_id", "left", ["request_id"], wanted.hot
    )
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    return paired.withColumn("news_vec", F.coalesce("news_vec", zeros)).join(users, "request_id")


def rerank(scored: DataFrame, k: int = RESULTS, score: Column | None = None) -> DataFrame:
    """Blend, round, and keep the best k; equal scores keep retrieval order."""
    mixed = score if score is not None else blend(F.col("retrieval_score"), F.col("neural_score"))
    order = Window.partitionBy("request_id").orderBy(
        F.desc("score"), "retrieval_rank", "article_id"
    )
    return (
        scored.withColumn("score", mixed)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def score_and_rank(
    candidates: DataFrame,
    requests: DataFrame,
    vectors: DataFrame,
    scorer: Scorer,
    wanted: Wanted,
    k: int = RESULTS,
    blend_on: str = "fused",
) -> DataFrame:
    """Score each candidate and keep the best k of each request.

    The blend takes the fused retrieval score, which may exceed one, or with
    ``blend_on="cosine"`` the cosine of the request and the scoring vector.
    """
    paired = with_vectors(candidates, requests, vectors, scorer.width, wanted)
    if blend_on == "cosine":
        paired = paired.withColumn(
            "retrieval_score", cosine(F.col("user_vec"), F.col("news_vec"))
        )
    elif blend_on != "fused":
        raise ValueError(f"blend on fused or cosine, not {blend_on}")
    return rerank(score_candidates(paired, scorer), k)


def enrich(
    ranked: DataFrame, payload: DataFrame, articles: DataFrame, wanted: Wanted, spread_by: list[str]
) -> DataFrame:
    """Attach payload and full article; fill title, summary and stamp if empty.

    Items without an article stay, with a null article.
    """
    light = payload.select(
        "article_id",
        F.col("title").alias("_title"),
        F.col("summary").alias("_summary"),
        F.col("tags").alias("_tags"),
        F.col("timestamp").alias("_timestamp"),
    )
    full = articles.select(
        F.col("id").alias("article_id"), F.struct(*articles.columns).alias("full_article")
    )
    # Payload and body are one row each per article: they meet first, so that the
    # many ranked rows are shuffled by article once.
    both = wanted.only(light).join(wanted.only(full), "article_id", "full")
    joined = skew_join(ranked, both, "article_id", "left", spread_by, wanted.hot)
    fa = F.col("full_article")
    stamp = fa["published_time_unix"]
    return joined.select(
        *[c for c in ranked.columns if c not in ("article_id",)],
        result_id(F.col("article_id")).alias("article_id"),
        F.coalesce(none_if_empty(F.col("_title")), fa["title"], F.lit("")).alias("title"),
        F.coalesce(
            none_if_empty(F.col("_summary")), fa["introductory_paragraph"], F.lit("")
        ).alias("summary"),
        F.coalesce("_tags", F.array().cast("array<string>")).alias("category"),
        F.coalesce("_timestamp", F.when(stamp != 0, stamp)).alias("timestamp"),
        fa,
    )


def latest(vectors: DataFrame, n: int = RESULTS) -> DataFrame:
    """The n newest articles; no stamp counts as zero."""
    stamp = F.coalesce(F.col("timestamp"), F.lit(0))
    return vectors.orderBy(stamp.desc(), "article_id").limit(n)


def latest_candidates(
    requests: DataFrame, vectors: DataFrame, n: int = LATEST_CANDIDATES, apply_filters: bool = False
) -> DataFrame:
    """The newest n articles as candidates of every request that asks for them.

    The feed has n rows by definition, so it is broadcast on its mode flag. With
    ``apply_filters`` the filters of each request thin the same feed.
    """
    from tidewire.operators.filters import passes

    stamp = F.coalesce(F.col("timestamp"), F.lit(0))
    place = Window.orderBy(stamp.desc(), "article_id")
    feed = latest(vectors.select("article_id", "tags", "timestamp"), n).select(
        F.lit(True).alias("use_latest"),
        "article_id",
        "tags",
        "timestamp",
        F.row_number().over(place).alias("retrieval_rank"),
    )
    asked = requests.where(F.col("use_latest")).select(
        "request_id", "use_latest", "categories", "days", "as_of_ms"
    )
    met = asked.join(F.broadcast(feed), "use_latest")
    if apply_filters:
        met = met.where(passes(F.col("tags"), F.col("timestamp"), F.col("categories"), F.col("days"), F.col("as_of_ms")))
    return met.select(
        "request_id",
        "article_id",
        F.lit(None).cast("double").alias("retrieval_score"),
        "retrieval_rank",
    )
