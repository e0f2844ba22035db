"""Every operator as a query over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import ids, portfolio, scoring, text, times, vectors
from tidewire.operators import embedding, filters, increment, metrics, normalise, ranking, sampling
from tidewire.operators import search
from tidewire.operators.scorer import DotScorer, NeuralScorer, initial_params
from tidewire.plans import embed as embed_plans
from tidewire.plans import ingest as ingest_plans
from tidewire.plans import recommend as rec
from tidewire.plans import training
from tidewire.session import materialise, work_dir
from tidewire.sources import readers, views
from tidewire.sources.tables import Store
from tidewire.streaming import jobs as streams

WIDTH = 64
ENCODER = embedding.HashingEncoder(WIDTH)
SEED = 7
#: Width of projected vectors.
PROJECTED = 8
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _score(c: str):
    return F.round(c, 6).alias(c)


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


# Articles and texts


@query
def article_normalise(spark, sf_dir):
    """Raw text rows to articles: safe texts, safe number, stable integer id."""
    doc = F.col("id").cast("bigint")
    stamp = F.col("published_time_unix").cast("string")
    raw = views.articles(spark, sf_dir).withColumns(
        {
            "published_time_unix": F.when(doc % 5 == 0, "abc")
            .when(doc % 5 == 1, F.concat(stamp, F.lit(".9")))
            .when(doc % 5 == 2, F.concat(F.lit(" "), stamp))
            .when(doc % 5 == 3, F.concat(F.lit("1.5d"), stamp))
            .otherwise(stamp),
            "tags": F.when(doc % 4 != 0, F.col("tags")),
            "id": F.when(doc % 9 == 0, "").when(doc % 2 == 0, F.concat(F.lit("doc-"), "id"))
            .otherwise(F.col("id")),
        }
    )
    return normalise.with_id(normalise.normalise(raw)).select(
        "id",
        ids.point_id(F.col("id")).alias("point_id"),
        F.length("title").alias("title_chars"),
        "tags",
        "published_time",
        "published_time_unix",
        ids.content_key(F.col("introductory_paragraph")).alias("content_key"),
    )


@query
def payload_projection(spark, sf_dir):
    """Pages to vector payloads: markup removed, entities decoded, summary cut."""
    pages = views.texts(spark, sf_dir, "pages")
    raw = pages.select(
        F.col("page_id").cast("string").alias("id"),
        F.col("url").alias("title"),
        F.col("html").alias("introductory_paragraph"),
        F.to_json(F.array(F.lit("page"), F.element_at(F.split("url", "/"), 3))).alias("tags"),
        F.lit(None).cast("bigint").alias("published_time_unix"),
    )
    return normalise.payload(raw).select("article_id", "title", "summary", _joined("tags"))


@query
def html_text(spark, sf_dir):
    """Whole pages as plain text."""
    plain = text.strip_html(F.col("html"))
    return views.texts(spark, sf_dir, "pages").select(
        "page_id", F.length(plain).alias("chars"), F.md5(plain).alias("digest")
    )


@query
def news_text(spark, sf_dir):
    """The text an article is embedded by, from its title and introduction."""
    whole = text.news_embedding_text(F.col("title"), F.col("introductory_paragraph"))
    return views.articles(spark, sf_dir).select(
        "id", F.length(whole).alias("chars"), F.md5(whole).alias("digest"),
        text.truncate(whole, embedding.QUERY_CHARS).alias("within_context"),
    )


@query
def query_text(spark, sf_dir):
    """The text a request is embedded by."""
    whole = text.user_query_text(F.col("clicked_news"), F.col("interests"), F.col("categories"))
    return views.text_requests(spark, sf_dir).select(
        "request_id", F.length(whole).alias("chars"), F.md5(whole).alias("digest")
    )


@query
def tags_parse(spark, sf_dir):
    """Tags in JSON, bracketed and broken forms."""
    doc = F.col("doc_id")
    raw = (
        F.when(doc % 4 == 0, F.to_json(F.array("lang", "source", F.lit(""), F.lit(" x "))))
        .when(doc % 4 == 1, F.concat(F.lit(" ["), "lang", F.lit(", ,"), "source", F.lit("] ")))
        .when(doc % 4 == 2, F.concat(F.lit('[0, null, true, 12, "'), "source", F.lit('"]')))
        .otherwise(F.concat("lang", F.lit(" , "), "source"))
    )
    tags = text.parse_tags(raw)
    return views.texts(spark, sf_dir, "documents").select(
        "doc_id", F.size(tags).alias("n"), F.array_join(tags, "|").alias("tags"),
        text.tags_as_text(tags).alias("tags_text"),
    )


@query
def typed_articles(spark, sf_dir):
    """Semi-structured columns, in JSON and in printed form, as typed columns."""
    doc = F.col("doc_id")
    digit = (doc % 10).cast("string")

    def cat(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    lang, source = F.col("lang"), F.col("source")
    economy = (
        F.when(doc % 4 == 0, cat("{score=", digit, ", reason=", source, " up}"))
        .when(doc % 4 == 1, cat('{"score": ', digit, ', "reason": "', lang, '"}'))
        .when(doc % 4 == 2, cat("{note ", lang, "}"))
        .otherwise("")
    )
    lines = F.when(doc % 2 == 0, cat("[{tag=", lang, ", text=", source, "}, {tag=Bear, text=down}]")).otherwise(
        cat('[{"tag": "', lang, '", "text": "', source, '"}]')
    )
    matrix = F.when(
        doc % 2 == 0,
        cat("[{type=Sector, entity=[{name=", source, ", score=", digit, ", reason=cuts, perception_line=", lang,
            "}, {name=Air, score=2, reason=fuel, perception_line=weak}]}, {type=None, entity=[]}]"),
    ).otherwise(
        cat('[{"type": "S", "entity": [{"name": "', source, '", "score": "', digit,
            '", "reason": "r", "perception_line": "', lang, '"}]}]')
    )
    raw = views.texts(spark, sf_dir, "documents").select(
        "doc_id",
        economy.alias("economyimpact"),
        lines.alias("perception_lines"),
        matrix.alias("impact_matrix"),
        F.to_json(F.array("lang", "source")).alias("tags"),
    )
    e = F.col("economyimpact")
    return normalise.typed(raw).select(
        "doc_id",
        e["score"].alias("economy_score"),
        e["reason"].alias("economy_reason"),
        F.array_join(
            F.transform("perception_lines", lambda p: F.concat(p["tag"], F.lit("="), p["text"])), ";"
        ).alias("perception"),
        F.array_join(
            F.transform(
                "impact_matrix",
                lambda t: F.concat(
                    t["type"], F.lit(":"),
                    F.array_join(
                        F.transform(
                            t["entity"],
                            lambda n: F.concat_ws("/", n["name"], n["score"], n["reason"], n["perception_line"]),
                        ),
                        ",",
                    ),
                ),
            ),
            ";",
        ).alias("impact"),
        F.to_json("perception_lines").alias("perception_json"),
    )


@query
def hour_keys(spark, sf_dir):
    """Events per hour key of the feed's zone."""
    events = views.table(spark, sf_dir, "events")
    keyed = events.select(times.hour_key(F.col("ts")).alias("hour"), times.hourly_path(F.col("ts")).alias("path"))
    return keyed.groupBy("hour", "path").agg(F.count("*").alias("events"))


# Lookups and counts


@query
def article_by_id(spark, sf_dir):
    """One article by its id."""
    found = filters.by_id(views.articles(spark, sf_dir), "7")
    return found.select("id", "title", "published_time_unix")


@query
def articles_by_ids(spark, sf_dir):
    """The articles whose label says good quality; unknown ids leave no row."""
    wanted = views.table(spark, sf_dir, "labels").where("quality = 1").select(
        (F.col("doc_id") * 2).cast("string").alias("id")
    )
    found = filters.by_ids(views.articles(spark, sf_dir), wanted)
    return found.select("id", "title", "published_time_unix")


@query
def tag_counts(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return metrics.tag_counts(d.select(F.col("doc_id").alias("article_id"), F.array("lang", "source").alias("tags")))


@query
def tag_index(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return metrics.tag_index(d.select(F.col("doc_id").alias("article_id"), F.array("lang", "source").alias("tags")))


@query
def vector_stats(spark, sf_dir):
    c = views.corpus(spark, sf_dir)
    some = c.withColumn("tags_vec", F.when(F.col("point_id") % 2 == 0, F.col("tags_vec")))
    return metrics.vector_stats(some)


@query
def vector_quality(spark, sf_dir):
    """Validity, norm and unit form of vectors, some of them broken."""
    v = F.col("vec_id")
    broken = (
        F.when(v % 10 == 0, F.slice("embedding", 1, 63))
        .when(v % 10 == 1, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .when(v % 10 == 2, F.transform("embedding", lambda x: x * 0))
        .when(v % 10 == 3, F.array().cast("array<float>"))
        .otherwise(F.transform("embedding", lambda x: (x * 3).cast("float")))
    )
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", broken.alias("b"))
    ok = vectors.is_valid_vector(F.col("b"), WIDTH)
    unit = vectors.l2_normalise(F.col("b"))
    pick = vectors.scoring_vector(F.col("b"), F.col("embedding"), F.lit(None).cast("array<float>"), WIDTH)
    return e.select(
        "vec_id",
        ok.alias("valid"),
        F.when(ok, F.round(vectors.norm(F.col("b")), 5)).alias("norm"),
        F.when(ok, F.round(unit[0].cast("double"), 5)).alias("unit_0"),
        F.when(ok, F.round(vectors.cosine(F.col("b"), F.col("embedding")), 5)).alias("cosine"),
        F.size(pick).alias("scoring_width"),
    )


@query
def score_blend(spark, sf_dir):
    """The blend rule over retrieval and neural scores, some of them missing."""
    doc = F.col("doc_id")
    q = F.when(doc % 5 != 0, (doc % 97) / 97.0)
    n = (doc % 53) / 1000.0
    return views.table(spark, sf_dir, "documents").select(
        "doc_id",
        scoring.blend(q, n).alias("score"),
        scoring.clamp((doc % 31) - 10, F.lit(0), F.lit(15)).alias("clamped"),
        scoring.match_percent(n).alias("match_percent"),
        ids.result_id(F.when(doc % 2 == 0, F.col("doc_id")), F.when(doc % 3 == 0, F.lit("")), F.lit("p"))
        .alias("result_id"),
    )


# Search and recommendation


@query
def topk_title(spark, sf_dir):
    """Best 50 by one named vector, with the tag filter only."""
    asked = views.vector_requests(spark, sf_dir).withColumn("days", F.lit(None).cast("int"))
    return search.topk(asked, views.corpus(spark, sf_dir), 50).select(
        "request_id", "article_id", _score("retrieval_score"), "retrieval_rank"
    )


@query
def topk_filtered(spark, sf_dir):
    """Best 20 by the description vector, with tag and recency filters."""
    asked = views.vector_requests(spark, sf_dir)
    return search.topk(asked, views.corpus(spark, sf_dir), 20, "description").select(
        "request_id", "article_id", _score("retrieval_score"), "retrieval_rank"
    )


@query
def topk_by_cells(spark, sf_dir):
    """The same search with the corpus in place: bounds from samples, requests in waves."""
    asked = views.vector_requests(spark, sf_dir)
    hits = search.topk(
        asked, views.corpus(spark, sf_dir), 50, "tags",
        broadcast_bytes=0, wave_bytes=512 << 10, sample_rows=256,
    )
    return hits.select("request_id", "article_id", _score("retrieval_score"), "retrieval_rank")


@query
def fusion_topk(spark, sf_dir):
    """Three lists of 100, fused by reciprocal rank to 50."""
    asked = views.vector_requests(spark, sf_dir)
    return search.fusion_topk(asked, views.corpus(spark, sf_dir), 50).select(
        "request_id", "article_id", _score("retrieval_score"), "retrieval_rank"
    )


def _items(results: DataFrame) -> DataFrame:
    fa = F.col("full_article")
    return results.select(
        *[c for c in ("request_id", "rank") if c in results.columns],
        "article_id",
        "title",
        F.md5("summary").alias("summary_digest"),
        _joined("category"),
        "timestamp",
        _score("score"),
        F.length(fa["introductory_paragraph"]).alias("full_chars"),
    )


@query
def latest_feed(spark, sf_dir):
    """The newest 50 articles, enriched."""
    return _items(rec.latest_feed(views.corpus(spark, sf_dir), views.articles(spark, sf_dir)))


@query
def feed_display(spark, sf_dir):
    """The feed as shown: date, percent, three tags, texts to fall back on."""
    feed = rec.latest_feed(views.corpus(spark, sf_dir), views.articles(spark, sf_dir))
    return metrics.feed_view(feed).select(
        "article_id", "title", F.length("summary").alias("summary_chars"), _joined("categories"),
        "display_date", "match_percent",
    )


@query
def recommend(spark, sf_dir):
    """Fusion or newest, a stand-in scorer, blend, rank, enrich; top 50 per user."""
    return _items(
        rec.recommend(
            views.vector_requests(spark, sf_dir), views.corpus(spark, sf_dir),
            views.articles(spark, sf_dir), DotScorer(WIDTH),
        )
    )


@query
def recommend_mlp(spark, sf_dir):
    """The same with the neural scorer at its seeded initial weights."""
    scorer = NeuralScorer(initial_params(WIDTH, SEED))
    return _items(
        rec.recommend(
            views.vector_requests(spark, sf_dir), views.corpus(spark, sf_dir),
            views.articles(spark, sf_dir), scorer,
        )
    )


@query
def recommend_cosine(spark, sf_dir):
    """The same with the blend on cosine and filters on the newest articles."""
    return _items(
        rec.recommend(
            views.vector_requests(spark, sf_dir), views.corpus(spark, sf_dir),
            views.articles(spark, sf_dir), DotScorer(WIDTH), 20,
            blend_on="cosine", filter_latest=True, rrf_k=60, rank_base=1,
        )
    )


@query
def recommend_latest(spark, sf_dir):
    """Newest 100 as candidates of every request that asks, filters applied."""
    asked = views.vector_requests(spark, sf_dir).withColumn("use_latest", F.lit(True))
    found = ranking.latest_candidates(asked, views.corpus(spark, sf_dir), apply_filters=True)
    return found.select("request_id", "article_id", "retrieval_rank")


def _text_corpus(spark, sf_dir) -> DataFrame:
    return materialise(embed_plans.named_vectors(views.articles(spark, sf_dir), ENCODER))


@query
def recommend_context(spark, sf_dir):
    """From clicked text and interests, through the encoder, to the ranked list."""
    return _items(
        rec.recommend_from_context(
            views.text_requests(spark, sf_dir), _text_corpus(spark, sf_dir),
            views.articles(spark, sf_dir), ENCODER, DotScorer(WIDTH), 10,
        )
    )


def _portfolio_asked(spark, sf_dir) -> DataFrame:
    n_docs = views.table(spark, sf_dir, "documents").count()
    return views.portfolios(spark, sf_dir).select(
        "*",
        F.array().cast("array<string>").alias("categories"),
        F.lit(None).cast("int").alias("days"),
        F.lit(views.FIRST_PUBLISHED_MS + n_docs * views.HOUR_MS).alias("as_of_ms"),
        F.lit(False).alias("use_latest"),
    )


@query
def recommend_portfolio(spark, sf_dir):
    """From portfolio documents to the ranked list; blank ones are rejected."""
    found, _ = rec.recommend_from_portfolio(
        _portfolio_asked(spark, sf_dir), _text_corpus(spark, sf_dir),
        views.articles(spark, sf_dir), ENCODER, DotScorer(WIDTH), 10,
    )
    return _items(found)


@query
def portfolio_text(spark, sf_dir):
    """The text of each portfolio document."""
    return portfolio.with_portfolio_text(views.portfolios(spark, sf_dir)).select("request_id", "query_text")


@query
def portfolio_trusts(spark, sf_dir):
    """Texts and accounts of documents that hold plans and trusts."""
    asked = portfolio.with_portfolio_text(views.trust_portfolios(spark, sf_dir))
    counts = portfolio.section_counts(portfolio.sections_of(F.col("portfolio")))
    return asked.withColumn("n", counts).select("request_id", "query_text", "n.sip", "n.reit", "n.invit")


@query
def portfolio_rejected(spark, sf_dir):
    """Requests whose document holds nothing to search for."""
    asked = portfolio.with_portfolio_text(views.portfolios(spark, sf_dir))
    _, rejected = filters.split_blank(asked, "query_text")
    return rejected.select("request_id", "reason")


@query
def portfolio_sections(spark, sf_dir):
    """Accounts per section of each document."""
    parsed = views.portfolios(spark, sf_dir).select(
        "request_id", portfolio.sections_of(F.col("portfolio")).alias("s")
    )
    return parsed.select("request_id", portfolio.section_counts(F.col("s")).alias("c")).select(
        "request_id", "c.deposits", "c.equities", "c.mutualfunds", "c.insurance_policies", "c.sip"
    )


# Increments


@query
def idempotent_new(spark, sf_dir):
    """Rows missing from either store, the last one per id."""
    incoming, article_store, vector_store = views.stored_parts(spark, sf_dir)
    last = increment.keep_last(incoming, "id", "_seq")
    new = increment.not_in_both(last, article_store, vector_store)
    return new.select("id", "title", F.col("_seq").alias("seq"))


@query
def capped_new(spark, sf_dir):
    """The next 500 new rows of a run, in source order."""
    incoming, article_store, vector_store = views.stored_parts(spark, sf_dir)
    last = increment.keep_last(incoming, "id", "_seq")
    new = increment.not_in_both(last, article_store, vector_store)
    return increment.cap_new(new, 500, "_seq").select("id", F.col("_seq").alias("seq"))


@query
def incremental_since(spark, sf_dir):
    """Rows past a mark, oldest first."""
    half = views.table(spark, sf_dir, "documents").count() // 2
    mark = views.FIRST_PUBLISHED_MS + half * views.HOUR_MS
    newer = increment.newer_than(views.articles(spark, sf_dir), mark)
    return newer.select("id", "published_time_unix", F.length("title").alias("title_chars"))


@query
def oldest_articles(spark, sf_dir):
    """The first 100 articles by publish number."""
    first = increment.oldest_first(views.articles(spark, sf_dir), 100)
    return first.select("id", "published_time_unix")


@query
def nested_text(spark, sf_dir):
    """The lake form's nested columns as JSON text."""
    d = views.texts(spark, sf_dir, "documents")
    entity = F.struct(
        F.col("source").alias("name"), (F.col("doc_id") % 5).cast("string").alias("score"),
        F.lit("r").alias("reason"), F.lit(None).cast("string").alias("perception_line"),
    )
    lake = d.select(
        "doc_id",
        F.struct((F.col("doc_id") % 10).cast("int").alias("score"), F.col("lang").alias("reason")).alias("economyimpact"),
        F.array(F.struct(F.lit("Sector").alias("type"), F.array(entity).alias("entity"))).alias("impact_matrix"),
        F.array(F.struct(F.col("lang").alias("tag"), F.col("source").alias("text"))).alias("perception_lines"),
        F.array("lang", "source").alias("tags"),
    )
    return normalise.nested_to_text(lake)


@query
def max_published(spark, sf_dir):
    """The newest stamp, the row count, and the mark after a batch."""
    a = views.articles(spark, sf_dir)
    batch = a.where("published_time_unix % 2 = 0")
    return (
        metrics.max_published(a)
        .withColumn("key", F.lit(1))
        .join(metrics.row_count(a).withColumn("key", F.lit(1)), "key")
        .join(metrics.max_published(batch).select(F.lit(1).alias("key"), F.col("max_published").alias("mark")), "key")
        .drop("key")
    )


@query
def run_metrics(spark, sf_dir):
    """Totals of a run whose rows carry an outcome."""
    doc = F.col("doc_id")
    outcome = (
        F.when(doc % 13 == 0, "error").when(doc % 6 == 0, "skipped").when(doc % 2 == 0, "ingested")
    )
    return metrics.run_metrics(views.table(spark, sf_dir, "documents").select(outcome.alias("outcome")))


# Embedding


def _components(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    each = F.explode(
        F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("vec")) for c, n in names.items()])
    )
    return (
        df.select(key, each.alias("f"))
        .select(key, "f.field", F.posexplode("f.vec").alias("slot", "value"))
        .where("value != 0")
        .select(key, "field", "slot", F.round(F.col("value").cast("double"), 5).alias("value"))
    )


@query
def embed_corpus(spark, sf_dir):
    """Three vectors per article, by component."""
    rows = embed_plans.named_vectors(views.articles(spark, sf_dir), ENCODER)
    return _components(
        rows, "article_id", {"title_vec": "title", "description_vec": "description", "tags_vec": "tags"}
    )


@query
def embed_common(spark, sf_dir):
    """One vector of title and introduction under all three names."""
    rows = embed_plans.common_vector(views.articles(spark, sf_dir), ENCODER)
    same = (F.col("title_vec") == F.col("description_vec")) & (F.col("title_vec") == F.col("tags_vec"))
    return _components(rows.where(same), "article_id", {"title_vec": "common"})


@query
def projected_vectors(spark, sf_dir):
    """Titles through the projection that a store keeps from its first run."""
    encoder = embedding.ProjectedEncoder(ENCODER, PROJECTED, SEED)
    store = Store(spark, work_dir(spark, "projected-store"), PROJECTED)
    store.bind(encoder)
    a = views.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "title")
    rows = embedding.embed(a, {"vec": F.col("title")}, store.bind(encoder))
    return _components(rows, "article_id", {"vec": "projected"})


@query
def embed_dedupe(spark, sf_dir):
    """Vectors of all documents, each distinct text encoded once, some from a cache."""
    d = views.texts(spark, sf_dir, "documents").select("doc_id", "text")
    cache = embedding.embedding_cache(d.where("doc_id % 4 = 0"), "text", ENCODER)
    rows = embedding.embed_with_reuse(d, "text", "vec", ENCODER, cache)
    return _components(rows, "doc_id", {"vec": "text"})


@query
def content_groups(spark, sf_dir):
    """Copies per distinct text."""
    d = views.table(spark, sf_dir, "documents")
    return d.groupBy(ids.content_key(F.col("text")).alias("content_key")).agg(F.count("*").alias("copies"))


# Training


def _tagged(spark, sf_dir) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    tags = F.when(F.col("doc_id") % 17 != 0, F.array("lang", "source"))
    return d.select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
    )


@query
def training_pairs(spark, sf_dir):
    """Positive and negative pairs, two per article."""
    tagged = _tagged(spark, sf_dir)
    n = tagged.count()
    order = [ids.seeded_order(SEED, F.col("article_id")), F.col("article_id")]
    indexed = sampling.dense_index(tagged, order, "idx")
    return sampling.training_pairs(indexed, n, 2 * n, SEED)


@query
def training_scan(spark, sf_dir):
    """The four columns that training reads."""
    return readers.training_articles(views.articles(spark, sf_dir)).select(
        "id", "title", F.md5("introductory_paragraph").alias("intro_digest"), "tags"
    )


@query
def training_sample(spark, sf_dir):
    """A random 500 articles to train on."""
    return sampling.random_cap(_tagged(spark, sf_dir), "article_id", 500, SEED).select(
        "article_id", _joined("tags")
    )


@query
def pair_losses(spark, sf_dir):
    """Mean loss of the seeded scorer over all training pairs, before it has learned."""
    tagged = _tagged(spark, sf_dir)
    n = tagged.count()
    order = [ids.seeded_order(SEED, F.col("article_id")), F.col("article_id")]
    pairs = sampling.training_pairs(sampling.dense_index(tagged, order, "idx"), n, 2 * n, SEED)
    vecs = views.corpus(spark, sf_dir).select("article_id", F.col("title_vec").alias("vec"))
    losses = training.mean_losses(training.pairs_with_vectors(pairs, vecs), initial_params(WIDTH, SEED))
    return losses.select("label", "pairs", F.round("mean_loss", 6).alias("mean_loss"))


@query
def train_scorer(spark, sf_dir):
    """Fit the scorer on two pairs per article of the vector table; loss per epoch."""
    pairs = 2 * views.table(spark, sf_dir, "documents").count()
    vectors_ = views.corpus(spark, sf_dir).select(
        "article_id", "tags", F.col("title_vec").alias("vec")
    )
    fitted = training.fit_on_articles(
        vectors_, initial_params(WIDTH, SEED), n_pairs=pairs, epochs=2,
        batch=training.BATCH, seed=SEED, max_articles=None,
    )
    return spark.createDataFrame(
        [(i + 1, float(loss)) for i, loss in enumerate(fitted.losses)], "epoch int, mean_loss double"
    )


@query
def refit_scorer(spark, sf_dir):
    """Two refits: from the start, then a warm start on what came later."""
    a = views.articles(spark, sf_dir)
    n = views.table(spark, sf_dir, "documents").count()
    half = views.FIRST_PUBLISHED_MS + n // 2 * views.HOUR_MS
    root = work_dir(spark, "model")
    sizes = {
        "n_pairs": n, "epochs": 1, "batch": training.BATCH, "seed": SEED, "max_articles": None,
    }
    older = a.where(F.col("published_time_unix") <= half)
    first, mark = training.refit(older, ENCODER, root, "0001", **sizes)
    second, last = training.refit(a, ENCODER, root, "0002", **sizes)
    rows = [("0001", mark, float(first.losses[-1])), ("0002", last, float(second.losses[-1]))]
    return spark.createDataFrame(rows, "version string, mark bigint, mean_loss double")


# Jobs that write tables, in the shared folder


def _store(spark, purpose) -> Store:
    return Store(spark, work_dir(spark, purpose), WIDTH)


def _table_rows(store: Store) -> DataFrame:
    """Both tables side by side."""
    a = store.read("articles").select(
        F.col("id").alias("article_id"), F.length("introductory_paragraph").alias("full_chars"),
        "published_time_unix",
    )
    v = store.read("vectors").select(
        "article_id", "point_id", "title", F.length("summary").alias("summary_chars"), _joined("tags"),
        "timestamp", F.size("title_vec").alias("width"),
    )
    return a.join(v, "article_id", "full")


@query
def ingest_lake(spark, sf_dir):
    """Two incremental runs over a growing lake table, the second from the mark."""
    path = work_dir(spark, "lake")
    a = views.articles(spark, sf_dir)
    lake = a.select(
        F.col("id").cast("bigint").alias("id"),
        F.to_timestamp("published_time").alias("published_time"),
        F.concat(F.lit(" "), "title").alias("title"),
        "introductory_paragraph", "descriptive_paragraph", "historical_context",
        F.struct(F.lit(5).alias("score"), F.lit("r").alias("reason")).alias("economyimpact"),
        F.from_json(F.lit("[]"), "array<struct<type:string,entity:array<struct<name:string,score:string,"
                    "reason:string,perception_line:string>>>>").alias("impact_matrix"),
        F.from_json(F.lit("[]"), "array<struct<tag:string,text:string>>").alias("perception_lines"),
        F.from_json("tags", "array<string>").alias("tags"),
        "ai_image_prompt", "processed_at", "published_time_unix",
    )
    half = views.FIRST_PUBLISHED_MS + views.table(spark, sf_dir, "documents").count() // 2 * views.HOUR_MS
    store = _store(spark, "lake-store")
    lake.where(F.col("published_time_unix") <= half).write.parquet(path)
    ingest_plans.ingest_lake(store, path, ENCODER)
    lake.where(F.col("published_time_unix") > half).write.mode("append").parquet(path)
    ingest_plans.ingest_lake(store, path, ENCODER)
    return _table_rows(store)


def _as_csv(spark, df: DataFrame, purpose: str) -> str:
    """The articles as CSV files with quoted line breaks."""
    path = work_dir(spark, purpose)
    df.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    return path


@query
def ingest_backfill(spark, sf_dir):
    """A CSV backfill in two bounded runs and a third that takes the rest."""
    store = _store(spark, "backfill-store")
    path = _as_csv(spark, views.articles(spark, sf_dir), "backfill")
    for limit in (100, 100, None):
        ingest_plans.ingest_backfill(store, path, ENCODER, limit)
    return _table_rows(store)


@query
def ingest_json(spark, sf_dir):
    """A drop-in of JSON lists, a file per day of articles."""
    a = views.articles(spark, sf_dir)
    day = F.floor(F.col("id").cast("bigint") / 24)
    lists = a.groupBy(day.alias("day")).agg(F.to_json(F.collect_list(F.struct(*a.columns))).alias("value"))
    path = work_dir(spark, "json")
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    store = _store(spark, "json-store")
    rows = readers.require_rows(readers.read_json(spark, path))
    ingest_plans.ingest(store, rows, ENCODER, "json", embed_plans.common_vector)
    return _table_rows(store)


@query
def ingest_drop_in(spark, sf_dir):
    """A drop-in by its suffix; half of its CSV files have other columns in another order."""
    path = f"{work_dir(spark, 'drop-in')}.csv"
    a = views.articles(spark, sf_dir)
    out = {"header": "true", "quoteAll": "true", "escape": '"'}
    odd = F.col("id").cast("bigint") % 2 == 1
    a.where(~odd).write.options(**out).csv(path)
    turned = [c for c in reversed(a.columns) if c != "ai_image_prompt"]
    a.where(odd).select(*turned, F.lit("x").alias("unknown")).write.mode("append").options(**out).csv(path)
    store = _store(spark, "drop-in-store")
    ingest_plans.ingest_drop_in(store, path, ENCODER)
    return _table_rows(store)


@query
def dry_run_counts(spark, sf_dir):
    """What each job would read, with nothing written."""
    a = views.articles(spark, sf_dir)
    csv_path = _as_csv(spark, a, "dry-run")
    lists = a.groupBy((F.col("id").cast("bigint") % 7).alias("k")).agg(F.to_json(F.collect_list(F.struct("id", "title"))).alias("value"))
    json_path = f"{work_dir(spark, 'dry-run')}.json"
    lists.select("value").write.option("maxRecordsPerFile", 1).text(json_path)
    store = _store(spark, "dry-run-store")
    jobs = {"backfill": ingest_plans.ingest_backfill(store, csv_path, ENCODER, dry_run=True)}
    jobs["drop_in"] = ingest_plans.ingest_drop_in(store, json_path, ENCODER, dry_run=True)
    rows = [(name, run["total"], store.runs().count()) for name, run in jobs.items()]
    return spark.createDataFrame(rows, "job string, total bigint, runs bigint")


def _hourly_files(spark, sf_dir, purpose: str, given: Column) -> str:
    """A file per day of articles in the order of their numbers; ``given`` is their id."""
    d = views.texts(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    fd = F.struct(F.split("text", "\n", 2)[0].alias("title"), F.array("lang").alias("tags"))
    article = F.struct(given.alias("id"), fd.alias("formatted_data"))
    listed = F.sort_array(F.collect_list(F.struct(doc, article.alias("a"))))
    files = d.groupBy(F.floor(doc / 24).alias("day")).agg(listed.alias("articles"))
    path = work_dir(spark, purpose)
    named = files.select(F.transform("articles", lambda x: x["a"]).alias("articles"))
    named.write.option("maxRecordsPerFile", 1).json(path)
    return path


@query
def hourly_without_ids(spark, sf_dir):
    """Hourly articles of which every third has no id: it gets its file's name and its place there."""
    doc = F.col("doc_id")
    path = _hourly_files(spark, sf_dir, "no-ids", F.when(doc % 3 != 0, doc.cast("string")))
    store = _store(spark, "no-ids-store")
    streams.stream_hourly(store, path, ENCODER, work_dir(spark, "no-ids-checkpoint")).awaitTermination()
    named = F.col("article_id").rlike("[.]json-[0-9]+$")
    return store.read("vectors").select(
        F.when(~named, F.col("article_id")).alias("given_id"),
        F.when(named, F.regexp_extract("article_id", "-([0-9]+)$", 1).cast("int")).alias("place"), "title",
    )


@query
def hourly_reread(spark, sf_dir):
    """A folder of hourly files read again under a new checkpoint: the same rows, each once."""
    path = _hourly_files(spark, sf_dir, "reread", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")))
    store = _store(spark, "reread-store")
    for _ in range(2):
        streams.stream_hourly(store, path, ENCODER, work_dir(spark, "reread-checkpoint")).awaitTermination()
    runs = store.runs().where("ingested > 0").count()
    return store.read("vectors").select("title", F.lit(runs).cast("bigint").alias("runs"))


@query
def quarantined(spark, sf_dir):
    """Hourly articles of which every seventh is malformed: what is stored, what is not."""
    path = work_dir(spark, "malformed")
    d = views.texts(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    score = F.when(doc % 7 == 0, F.lit('"high"')).otherwise((doc % 10).cast("string"))
    article = F.format_string(
        '{"id":"%s","formatted_data":{"title":"t %s","economyImpact":{"score":%s}}}', doc.cast("string"), doc.cast("string"), score
    )
    files = d.groupBy(F.floor(doc / 24).alias("day")).agg(F.array_join(F.collect_list(article), ",").alias("list"))
    files.select(F.format_string('{"articles":[%s]}', "list").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    store = _store(spark, "malformed-store")
    streams.stream_hourly(store, path, ENCODER, work_dir(spark, "malformed-checkpoint")).awaitTermination()
    stored = store.read("vectors").select("article_id", F.lit("stored").alias("outcome"))
    refused = store.read("quarantine").select(F.get_json_object("record", "$.id").alias("article_id"), F.col("reason").alias("outcome"))
    return stored.union(refused)


@query
def ingest_runs(spark, sf_dir):
    """The run records of a drop-in ingest that comes twice, then grows."""
    store = _store(spark, "drop-store")
    a = views.articles(spark, sf_dir)
    first = _as_csv(spark, a.where("cast(id as bigint) % 3 = 0"), "drop")
    every = _as_csv(spark, a, "drop")
    for path in (first, first, every):
        rows = readers.read_csv(spark, path)
        ingest_plans.ingest(store, rows, ENCODER, "drop", embed_plans.common_vector)
    return store.runs().select(
        F.col("batch").cast("int").alias("batch"), "total", "ingested", "skipped", "errors", "mark", "status"
    )


@query
def hourly_stream(spark, sf_dir):
    """Hourly files, streamed to the vector table."""
    path = work_dir(spark, "hourly")
    d = views.texts(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    fd = F.struct(
        F.when(doc % 3 != 0, F.split("text", "\n", 2)[0]).alias("title"),
        F.col("text").alias("descriptive_paragraph"),
        F.array("lang", "source").alias("tags"),
        F.struct((doc % 10).cast("int").alias("score")).alias("economyImpact"),
    )
    article = F.struct(
        doc.cast("string").alias("id"),
        F.concat(F.lit("original "), doc.cast("string")).alias("original_title"),
        F.date_format(F.timestamp_millis(F.lit(views.FIRST_PUBLISHED_MS) + doc * views.HOUR_MS),
                      "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("published_time"),
        fd.alias("formatted_data"),
    )
    # A file holds the articles of one day, so its size is bounded by the feed.
    files = d.groupBy(F.floor(doc / 24).alias("day")).agg(F.sort_array(F.collect_list(article)).alias("articles"))
    files.select("articles").write.option("maxRecordsPerFile", 1).json(path)
    store = _store(spark, "hourly-store")
    checkpoint = work_dir(spark, "hourly-checkpoint")
    streams.stream_hourly(store, path, ENCODER, checkpoint).awaitTermination()
    return store.read("vectors").select(
        "article_id", "point_id", "title", F.length("summary").alias("summary_chars"), _joined("tags"),
        "timestamp", "published_time", "economy_impact", F.size("tags_vec").alias("width"),
    )


@query
def csv_stream(spark, sf_dir):
    """CSV files dropped into a folder, streamed to both tables."""
    path = _as_csv(spark, views.articles(spark, sf_dir).repartition(4, "id"), "csv-drop")
    store = _store(spark, "csv-store")
    checkpoint = work_dir(spark, "csv-checkpoint")
    streams.stream_csv(store, path, ENCODER, checkpoint, files_per_batch=2).awaitTermination()
    return _table_rows(store)
