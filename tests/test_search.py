"""Search, fusion and skewed joins against brute force."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.operators import filters, ranking, search
from tidewire.operators.scorer import DotScorer, NeuralScorer, initial_params
from tidewire.operators.skew import hot_keys, skew_join
from tidewire.plans import recommend as rec
from tidewire.schemas import VECTOR_COLUMNS

DAY = 86_400_000
NOW = 100 * DAY
WIDTH = 8
N_ARTICLES, N_REQUESTS = 300, 40


def fixture_rows():
    rng = np.random.default_rng(3)
    articles, requests = [], []
    # A third of all articles are copies of one, as are a third of all requests.
    same = rng.normal(size=(3, WIDTH)).astype(np.float32)
    for i in range(N_ARTICLES):
        v = same if i % 3 == 0 else rng.normal(size=(3, WIDTH)).astype(np.float32)
        vecs = [v[j].tolist() for j in range(3)]
        if i % 50 == 1:
            vecs[1] = None
        if i % 50 == 2:
            vecs[0] = [0.0] * WIDTH
        stamp = None if i % 11 == 0 else NOW - (i % 30) * DAY
        articles.append((str(i), *vecs, [f"t{i % 5}", "all"], stamp))
    asked = rng.normal(size=WIDTH)
    for i in range(N_REQUESTS):
        q = asked if i % 3 == 0 else rng.normal(size=WIDTH)
        cats = [] if i % 2 else [f"t{i % 7}"]
        requests.append((f"r{i}", [float(x) for x in np.float32(q)], cats, (None, 0, 7)[i % 3], NOW, i % 8 == 7))
    return articles, requests


@pytest.fixture(scope="module")
def tables(spark):
    articles, requests = fixture_rows()
    corpus = spark.createDataFrame(
        articles,
        "article_id string, title_vec array<float>, description_vec array<float>, "
        "tags_vec array<float>, tags array<string>, timestamp bigint",
    ).repartition(3)
    asked = spark.createDataFrame(
        requests,
        "request_id string, query_vec array<float>, categories array<string>, days int, "
        "as_of_ms bigint, use_latest boolean",
    )
    return corpus, asked, articles, requests


def brute(articles, requests, k, which):
    out = {}
    for rid, q, cats, days, now, _ in requests:
        scored = []
        for a in articles:
            vec, tags, stamp = a[1 + which], a[4], a[5]
            if vec is None or (cats and not set(cats) & set(tags)):
                continue
            if days and (stamp is None or stamp < now - days * DAY):
                continue
            v, u = np.float64(vec), np.float64(q)
            scale = np.linalg.norm(v) * np.linalg.norm(u)
            scored.append((-round(float(v @ u / scale), 9) if scale else 0.0, a[0]))
        out[rid] = [(aid, -s) for s, aid in sorted(scored)[:k]]
    return out


SIZES = [
    {},
    {"broadcast_bytes": 6000},
    {"broadcast_bytes": 0},
    {"broadcast_bytes": 0, "wave_bytes": 1500, "sample_rows": 10},
    {"broadcast_bytes": 0, "wave_bytes": 4000, "sample_rows": 1},
]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("k", [5, 120])
def test_topk_is_exact_every_way(tables, sizes, k):
    corpus, asked, articles, requests = tables
    for which, field in enumerate(["title", "description"]):
        got = {}
        for r in search.topk(asked, corpus, k, field, **sizes).collect():
            got.setdefault(r["request_id"], {})[r["retrieval_rank"]] = (r["article_id"], r["retrieval_score"])
        want = brute(articles, requests, k, which)
        for rid, rows in want.items():
            ours = [got.get(rid, {})[i + 1] for i in range(len(rows))]
            assert [a for a, _ in ours] == [a for a, _ in rows]
            assert np.allclose([s for _, s in ours], [s for _, s in rows], atol=1e-9)
            assert len(got.get(rid, {})) == len(rows)


def test_fusion_against_brute_force(tables):
    corpus, asked, articles, requests = tables
    k = 10
    lists = [brute(articles, requests, 2 * k, w) for w in range(3)]
    got = {}
    for r in search.fusion_topk(asked, corpus, k).collect():
        got.setdefault(r["request_id"], []).append((r["retrieval_rank"], r["article_id"], r["retrieval_score"]))
    for rid, *_ in requests:
        score = {}
        for each in lists:
            for place, (aid, _) in enumerate(each[rid]):
                score[aid] = score.get(aid, 0.0) + 1.0 / (2 + place)
        want = sorted((-round(s, 9), a) for a, s in score.items())[:k]
        ours = [(a, s) for _, a, s in sorted(got.get(rid, []))]
        assert [a for a, _ in ours] == [a for _, a in want]
        union = {a for each in lists for a, _ in each[rid]}
        assert {a for a, _ in ours} <= union


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line]


def test_corpus_stays_in_place(spark, tables, tmp_path):
    corpus, asked, *_ = tables
    corpus.write.parquet(str(tmp_path / "corpus"))
    stored = spark.read.parquet(str(tmp_path / "corpus"))
    hits = search.topk(asked, stored, 5, broadcast_bytes=0, sample_rows=10)
    assert _exchanges(hits)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition") :]
    scan = below.splitlines()[1]
    assert "MapInArrow" in scan and "vec" not in scan.split("function")[-1].split("[request_id", 1)[-1]
    for line in _exchanges(hits):
        assert "vec" not in line and "tags" not in line


def test_tasks_emit_only_what_reaches_the_bound(spark):
    """With floors of a sample, hits per request stay far below k times the batches."""
    rng = np.random.default_rng(8)
    rows = [(str(i), rng.normal(size=WIDTH).astype(np.float32).tolist(), None, None) for i in range(6000)]
    corpus = spark.createDataFrame(rows, "article_id string, title_vec array<float>, tags array<string>, timestamp bigint")
    asked = spark.createDataFrame(
        [(f"r{i}", rng.normal(size=WIDTH).astype(np.float32).tolist(), None, None) for i in range(5)],
        "request_id string, query_vec array<float>, categories array<string>, cutoff_ms bigint",
    )
    plan = (asked, corpus.repartition(40), ["title_vec"], [0], 10)
    sample = corpus.where(F.pmod(F.xxhash64("article_id"), F.lit(16)) == 0)
    found = search._ranked(search._nearest_in_place(asked, sample, ["title_vec"], [0], 10, None), 10)
    floors = found.where("place = 10").select("request_id", "list", "score")
    loose = search._nearest_in_place(*plan, None)
    tight = search._nearest_in_place(*plan, floors)
    assert loose.count() == 5 * 10 * 40
    assert tight.count() <= 5 * 10 * 30
    best = [sorted(map(tuple, search._ranked(x, 10).collect())) for x in (loose, tight)]
    assert best[0] == best[1]


def test_products_follow_the_filters(monkeypatch):
    """Multiplications are those of the pairs that the filters allow."""
    rng = np.random.default_rng(2)
    n, done = 500, []
    tags = [[f"t{i % 20}", "all"] if i % 9 else None for i in range(n)]
    stamps = [None if i % 11 == 0 else i for i in range(n)]
    stored = search._block(
        pa.table({
            "article_id": [str(i) for i in range(n)], "v": [None if i % 50 == 3 else rng.normal(size=WIDTH).tolist() for i in range(n)],
            "tags": pa.array(tags, pa.list_(pa.string())), "timestamp": pa.array(stamps, pa.int64()),
        }), "article_id", ["v"], "timestamp", "tags", WIDTH,
    )
    wanted = [["t1"], ["t1", "t2", None], None, None, ["none"], ["t1"], ["all"]]
    cutoffs = [None, 250, 400, None, None, 480, 100]
    asked = search._block(
        pa.table({
            "request_id": [f"r{i}" for i in range(7)], "v": [rng.normal(size=WIDTH).tolist() for _ in range(7)],
            "categories": pa.array(wanted, pa.list_(pa.string())), "cutoff_ms": pa.array(cutoffs, pa.int64()),
        }), "request_id", ["v"], "cutoff_ms", "categories", WIDTH,
    )
    product = search._product
    monkeypatch.setattr(search, "_product", lambda q, u: done.append(len(q) * len(u)) or product(q, u))
    hits = {}
    for _, rows, scores, ids in search._cell(asked, stored, 600):
        for r, a in zip(rows, ids, strict=True):
            hits.setdefault(int(r), set()).add(int(a))
    allowed = {
        r: {
            i for i in range(n)
            if i % 50 != 3 and (wanted[r] is None or set(wanted[r]) & set(tags[i] or []))
            and (cutoffs[r] is None or (stamps[i] is not None and stamps[i] >= cutoffs[r]))
        }
        for r in range(7)
    }
    assert hits == {r: a for r, a in allowed.items() if a}
    assert sum(done) == sum(map(len, allowed.values()))


def test_copies_of_a_vector_are_multiplied_once(monkeypatch):
    """Of equal vectors the least ids count, behind a floor of score and id those up to its id."""
    rng = np.random.default_rng(4)
    n, k, done = 900, 12, []
    few = rng.normal(size=(6, WIDTH)).astype(np.float32)
    of = rng.integers(0, 6, n)
    ids = [str(i) for i in rng.permutation(n)]
    stamps = [i % 30 for i in range(n)]
    table = pa.table({"article_id": ids, "v": few[of].tolist(), "tags": pa.nulls(n, pa.list_(pa.string())), "timestamp": stamps})
    stored = search._block(table, "article_id", ["v"], "timestamp", "tags", WIDTH)
    queries, cutoffs = rng.normal(size=(8, WIDTH)).astype(np.float32), [None, 5, 29, None] * 2
    asked = search._block(
        pa.table({
            "request_id": [f"r{i}" for i in range(8)], "v": queries.tolist(),
            "categories": pa.nulls(8, pa.list_(pa.string())), "cutoff_ms": pa.array(cutoffs, pa.int64()),
        }), "request_id", ["v"], "cutoff_ms", "categories", WIDTH,
    )
    product = search._product
    monkeypatch.setattr(search, "_product", lambda q, u: done.append(len(q) * len(u)) or product(q, u))

    def best(block):
        out = {}
        for _, rows, scores, found in search._cell(block, stored, k):
            for r, s, a in zip(rows, scores, found, strict=True):
                out.setdefault(int(r), []).append((-float(s), a))
        return out

    got = best(asked)
    exact = queries.astype(np.float64) @ few.astype(np.float64).T
    exact /= np.linalg.norm(queries.astype(np.float64), axis=1)[:, None] * np.linalg.norm(few.astype(np.float64), axis=1)
    for r in range(8):
        allowed = [i for i in range(n) if cutoffs[r] is None or stamps[i] >= cutoffs[r]]
        want = sorted((-round(exact[r, of[i]], 9) + 0.0, ids[i]) for i in allowed)[:k]
        assert [a for _, a in got[r]] == [a for _, a in want]
    assert sum(done) <= 8 * 6
    floors = np.array([[-got[r][-1][0]] for r in range(8)])
    last = np.array([[got[r][4][1]] for r in range(8)], dtype=object)
    behind = best(replace(asked, floors=floors, floor_ids=last))
    for r in range(8):
        assert behind[r] == [x for x in got[r] if x[0] < got[r][-1][0] or x[1] <= last[r, 0]]


def test_bounds_of_a_sample_keep_ties_few(spark):
    """Articles that tie with the bound count up to the id of it, however many there are."""
    rng = np.random.default_rng(9)
    few = rng.normal(size=(4, WIDTH)).astype(np.float32)
    rows = [(str(i), few[i % 4].tolist(), None, None) for i in range(6000)]
    corpus = spark.createDataFrame(rows, "article_id string, title_vec array<float>, tags array<string>, timestamp bigint")
    asked = spark.createDataFrame(
        [(f"r{i}", rng.normal(size=WIDTH).astype(np.float32).tolist(), None, None, None) for i in range(5)],
        "request_id string, query_vec array<float>, categories array<string>, days int, as_of_ms bigint",
    )
    ready = search.requests_for_search(asked)
    sample = corpus.where(F.pmod(F.xxhash64("article_id"), F.lit(8)) == 0)
    floors = search._nearest_in_broadcast(ready, sample, ["title_vec"], [0], 10, only_last=True)
    assert floors.count() == 5
    tight = search._nearest_in_place(ready, corpus.repartition(40), ["title_vec"], [0], 10, floors)
    assert tight.count() <= 5 * 10 * 20
    want = search.topk(asked, corpus, 10)
    got = search.topk(asked, corpus, 10, broadcast_bytes=0, sample_rows=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_search_of_nothing(spark, tables):
    corpus, asked, *_ = tables
    assert search.topk(asked.limit(0), corpus, 5).count() == 0
    assert search.topk(asked, corpus.limit(0), 5).count() == 0


def test_mixed_widths_are_refused(spark, tables):
    corpus, asked, *_ = tables
    wide = asked.withColumn("query_vec", F.concat("query_vec", "query_vec"))
    with pytest.raises(Exception, match="width"):
        search.topk(wide, corpus, 5).collect()


def test_skew_join_keeps_every_row(spark):
    left = spark.range(9000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"),
    )
    right = spark.range(400).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", -1)], "key string, v bigint"))
    hot = hot_keys(left, "key", share=10, min_piece=100)
    assert [(r["key"], r["_copies"]) for r in hot.collect()] == [("hot", 4)]
    assert hot_keys(left, "key") is None
    for how in ("inner", "left", "left_semi"):
        want = left.join(right, "key", how)
        got = skew_join(left, right, "key", how, ["row"], hot)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(
            map(tuple, want.collect()), key=repr
        )
    with pytest.raises(ValueError):
        skew_join(left, right, "key", "full", ["row"], hot)


def test_filters(spark):
    rows = [
        (["a"], 100, ["a", "b"], 7, True), (["c"], 100, ["a"], None, False), (["c"], None, [], 7, False),
        (["c"], None, [], 0, True), (None, 100, None, None, True), (None, 100, ["a"], None, False),
    ]
    df = spark.createDataFrame(rows, "tags array<string>, ts bigint, cats array<string>, days int, want boolean")
    ok = filters.passes(F.col("tags"), F.col("ts"), F.col("cats"), F.col("days"), F.lit(7 * DAY + 100))
    assert all(r["ok"] == r["want"] for r in df.select(ok.alias("ok"), "want").collect())


def test_rerank_is_stable(spark):
    rows = [("r", "x", 0.4, 2, 0.4), ("r", "y", 0.4, 1, 0.4), ("r", "z", None, 3, 0.9)]
    df = spark.createDataFrame(
        rows, "request_id string, article_id string, retrieval_score double, retrieval_rank int, neural_score double"
    )
    got = [(r["rank"], r["article_id"], r["score"]) for r in ranking.rerank(df, 2).orderBy("rank").collect()]
    assert got == [(1, "z", 0.45), (2, "y", 0.4)]


def test_enrichment_fills_only_what_is_empty(spark):
    ranked = spark.createDataFrame([("r", 1, "a", 0.5), ("r", 2, "b", 0.4), ("r", 3, "gone", 0.3)],
                                   "request_id string, rank int, article_id string, score double")
    payload = spark.createDataFrame(
        [("a", "", None, ["t"], None), ("b", "Own", "own", None, 5), ("gone", "Kept", "k", ["t"], None)],
        "article_id string, title string, summary string, tags array<string>, timestamp bigint",
    )
    articles = spark.createDataFrame(
        [("a", "Full", "<p>raw</p>", 9), ("b", "Other", "other", 8)],
        "id string, title string, introductory_paragraph string, published_time_unix bigint",
    )
    for hot in (None, spark.createDataFrame([("a", 3)], "article_id string, _copies int")):
        wanted = ranking.Wanted(ranked.select("article_id"), hot)
        got = {r["article_id"]: r for r in ranking.enrich(ranked, payload, articles, wanted, ["request_id"]).collect()}
        assert (got["a"]["title"], got["a"]["summary"], got["a"]["timestamp"]) == ("Full", "<p>raw</p>", 9)
        assert (got["b"]["title"], got["b"]["summary"], got["b"]["timestamp"], got["b"]["category"]) == ("Own", "own", 5, [])
        assert got["gone"]["full_article"] is None and got["gone"]["title"] == "Kept"
        assert len(got) == 3


def test_recommend_in_both_modes(spark, tables):
    corpus, asked, articles, requests = tables
    vectors = corpus.select("*", F.lit("").alias("title"), F.lit("").alias("summary"))
    full = corpus.select(
        F.col("article_id").alias("id"), F.concat(F.lit("T"), "article_id").alias("title"),
        F.lit("i").alias("introductory_paragraph"), F.col("timestamp").alias("published_time_unix"),
    )
    got = rec.recommend(asked, vectors, full, DotScorer(WIDTH), 20).collect()
    ranks = {}
    for r in got:
        ranks.setdefault(r["request_id"], []).append((r["rank"], r["score"], r["article_id"], r["title"]))
    newest = {a[0] for a in sorted(articles, key=lambda a: (-(a[5] or 0), a[0]))[:100]}
    for rid, *_, use_latest in requests:
        rows = sorted(ranks.get(rid, []))
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert all(x[1] >= y[1] for x, y in zip(rows, rows[1:], strict=False))
        assert all(r[3] == f"T{r[2]}" for r in rows)
        if use_latest:
            assert len(rows) == 20 and {r[2] for r in rows} <= newest
    plain = ranking.latest_candidates(asked, vectors)
    thinned = ranking.latest_candidates(asked, vectors, apply_filters=True)
    assert plain.count() == 100 * sum(r[5] for r in requests)
    assert thinned.count() < plain.count()
    assert VECTOR_COLUMNS[0] in vectors.columns


def test_ranking_does_not_depend_on_partitions(tables):
    corpus, asked, *_ = tables
    def rows(parts):
        return sorted(map(tuple, search.fusion_topk(asked.repartition(parts), corpus.repartition(parts), 7).select(
            "request_id", "article_id", "retrieval_score", "retrieval_rank").collect()))
    assert rows(1) == rows(5)


def test_waves_share_one_pass_over_the_corpus(tables, monkeypatch):
    """Several waves of requests are met by one job, each held by itself."""
    corpus, asked, articles, requests = tables
    passes, in_place = [], search._nearest_in_place
    monkeypatch.setattr(search, "_nearest_in_place", lambda *a: passes.append(a) or in_place(*a))
    found = search.topk(asked, corpus, 5, broadcast_bytes=0, wave_bytes=1500, sample_rows=10_000)
    want = brute(articles, requests, 5, 0)
    got = {}
    for r in found.collect():
        got.setdefault(r["request_id"], {})[r["retrieval_rank"]] = r["article_id"]
    assert all([got[rid][i + 1] for i in range(len(rows))] == [a for a, _ in rows] for rid, rows in want.items() if rows)
    assert len(passes) == 1


@pytest.fixture
def travelling(monkeypatch):
    """Articles travel in small blocks and several rounds, however few the requests."""
    monkeypatch.setattr(search, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(search, "ROUND_BYTES", 22_000)
    monkeypatch.setattr(search, "HIT_BYTES", 1 << 20)
    rounds, made = [], search._round
    monkeypatch.setattr(search, "_round", lambda *a: rounds.append(a) or made(*a))
    return rounds


@pytest.mark.parametrize("law", [{}, {"rrf_k": 60, "rank_base": 1}])
def test_travelling_articles_need_no_shuffle_of_hits(tables, travelling, law):
    """In rounds the fused lists are those of a corpus that travels as a whole, to the digit."""
    corpus, asked, *_ = tables
    found = search.fusion_topk(asked, corpus, 10, broadcast_bytes=1, **law)
    assert len(travelling) > 2
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    columns = ["request_id", "article_id", "retrieval_score", "retrieval_rank"]
    whole = search.fusion_topk(asked, corpus, 10, **law).select(columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, whole.collect()))


def test_travelling_articles_with_repeated_ids(spark, tables, travelling):
    """Ids of requests and of articles may repeat, also past the end of a block."""
    corpus, asked, *_ = tables
    turned = asked.withColumn("query_vec", F.transform("query_vec", lambda x: -x))
    twice = asked.unionByName(turned.where("request_id < 'r2'"))
    again = corpus.unionByName(corpus.where("article_id < '3'").withColumn("timestamp", F.lit(NOW)))
    for requests in (asked, twice):
        for k in (5, 120):
            found = search.topk(requests, again, k, broadcast_bytes=1)
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.topk(requests, again, k).collect()))
        fused = [search.fusion_topk(requests, again, 7, broadcast_bytes=b).collect() for b in (1, 1 << 20)]
        rows = [sorted((r["request_id"], r["retrieval_rank"], r["article_id"], r["retrieval_score"]) for r in f) for f in fused]
        assert rows[0] == rows[1]
    assert len(travelling) > 12


def test_sums_are_rounded_as_sql_does(spark):
    values = [0.5 + 2**-10, 2**-10, 1 / 3, -(2**-10), 1.0000000005, 0.1234567895, 1.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9)).collect()
    assert search._half_up(np.array(values), 9).tolist() == [r[0] for r in rows]


@pytest.mark.parametrize("kind", ["recommend", "recommend_mlp", "recommend_cosine"])
def test_recommendations_of_travelling_articles(tables, travelling, monkeypatch, kind):
    corpus, asked, *_ = tables
    vectors = corpus.select("*", F.lit("").alias("title"), F.lit("").alias("summary"))
    full = corpus.select(
        F.col("article_id").alias("id"), F.concat(F.lit("T"), "article_id").alias("title"),
        F.lit("i").alias("introductory_paragraph"), F.col("timestamp").alias("published_time_unix"),
    )
    scorer = NeuralScorer(initial_params(WIDTH, 7)) if kind == "recommend_mlp" else DotScorer(WIDTH)
    law = {"blend_on": "cosine", "filter_latest": True, "rrf_k": 60, "rank_base": 1} if kind == "recommend_cosine" else {}

    def rows():
        found = rec.recommend(asked, vectors, full, scorer, 20, **law)
        return sorted((r["request_id"], r["rank"], r["article_id"], round(r["score"], 6), r["title"]) for r in found.collect())

    want = rows()
    assert not travelling
    monkeypatch.setattr(rec, "fusion_topk", lambda *a, **b: search.fusion_topk(*a, **b, broadcast_bytes=1))
    assert rows() == want
    assert len(travelling) > 2
