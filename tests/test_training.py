"""Encoder, scorer, gradients, pairs and fitting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions.ids import seeded_order
from tidewire.operators import embedding, sampling, scorer
from tidewire.plans import training
from tidewire.sources.tables import load_mark, load_model

WIDTH = 4
HIDDEN = (16, 8, 4)


def params(seed=1):
    return scorer.initial_params(WIDTH, seed, HIDDEN)


def batch(n=6, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 2 * WIDTH)), (rng.random(n) > 0.5).astype(float)


def test_gradients_by_finite_differences():
    p, (x, y) = params(), batch()
    rng = np.random.default_rng(1)
    masks = [(rng.random((6, 16)) > 0.3) / 0.7, (rng.random((6, 8)) > 0.2) / 0.8]
    _, grads = scorer.gradients(p, x, y, masks)
    for name in p:
        for _ in range(3):
            at = tuple(rng.integers(s) for s in p[name].shape)
            was = p[name][at]
            p[name][at] = was + 1e-6
            up, _ = scorer.gradients(p, x, y, masks)
            p[name][at] = was - 1e-6
            down, _ = scorer.gradients(p, x, y, masks)
            p[name][at] = was
            assert grads[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_forward_by_hand():
    p = scorer.initial_params(WIDTH, 3)
    x, _ = batch(5)
    a = x
    for layer in range(3):
        z = a @ p[f"w{layer}"].T + p[f"b{layer}"]
        if layer < 2:
            z = (z - z.mean(1, keepdims=True)) / np.sqrt(z.var(1, keepdims=True) + 1e-5)
        a = np.maximum(z, 0)
    want = 1 / (1 + np.exp(-(a @ p["w3"].T)[:, 0]))
    got = scorer.NeuralScorer(p).score(x[:, :WIDTH], x[:, WIDTH:])
    assert np.allclose(got, want, atol=1e-12)
    assert [p[f"w{i}"].shape for i in range(4)] == [(512, 8), (128, 512), (32, 128), (1, 32)]
    assert np.abs(p["w0"]).max() <= np.sqrt(6 / (8 + 512)) and not p["b0"].any()


def test_score_candidates(spark):
    x, _ = batch(20)
    rows = [(i, x[i, :WIDTH].tolist(), x[i, WIDTH:].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "row int, user_vec array<float>, news_vec array<float>").repartition(3)
    got = {r["row"]: r["neural_score"] for r in scorer.score_candidates(df, scorer.NeuralScorer(params())).collect()}
    want, _ = scorer.forward(params(), np.float32(x).astype(float))
    assert np.allclose([got[i] for i in range(20)], want, atol=1e-12)
    assert all(0 <= s <= 1 for s in got.values())


def test_encoder(spark):
    texts = ["Oil prices rise", "oil PRICES rise", "", None, "naïve café"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    encode = embedding.encode_column(embedding.HashingEncoder(16))
    got = {r["i"]: r["v"] for r in df.repartition(3).select("i", encode(F.col("t")).alias("v")).collect()}
    assert got[0] == got[1] and got[3] is None and not any(got[2])
    assert sum(x * x for x in got[4]) == pytest.approx(1, abs=1e-6)
    small = embedding.ProjectedEncoder(embedding.HashingEncoder(16), 6, seed=2)
    vecs = small.load()(["a b c", ""])
    assert vecs.shape == (2, 6) and np.linalg.norm(vecs[0]) == pytest.approx(1, abs=1e-6)
    assert np.array_equal(vecs, small.load()(["a b c", ""]))


class CountingEncoder(embedding.HashingEncoder):
    """Marks the vector of any text it is given, so reuse shows."""

    def load(self):
        return lambda texts: np.full((len(texts), self.width), 9, dtype=np.float32)


def test_embedding_reuse(spark):
    df = spark.createDataFrame([(i, ("same", "other", None, "new")[i % 4]) for i in range(40)], "i int, t string")
    first = embedding.HashingEncoder(8)
    cache = embedding.embedding_cache(df.where("t != 'new'"), "t", first)
    assert cache.count() == 2
    rows = embedding.embed_with_reuse(df, "t", "vec", CountingEncoder(8), cache).collect()
    assert len(rows) == 40
    for r in rows:
        if r["t"] is None:
            assert r["vec"] is None
        else:
            assert (r["vec"] == [9.0] * 8) == (r["t"] == "new")


def test_context_limit_applies_to_bounded_encoders(spark):
    df = spark.createDataFrame([("aa bb " * 10,)], "t string")
    whole = embedding.encode_column(embedding.HashingEncoder(8))
    cut = embedding.encode_column(embedding.HashingEncoder(8, max_chars=2))
    r = df.select(whole(F.col("t")).alias("w"), cut(F.col("t")).alias("c")).first()
    assert r["w"] != r["c"]
    assert r["c"] == embedding.HashingEncoder(8).load()(["aa"])[0].tolist()


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(str(i), [] if i == 5 else [f"t{i % 3}"], [float(i), 1.0, 0.0, float(-i)]) for i in range(30)]
    return spark.createDataFrame(rows, "article_id string, tags array<string>, vec array<float>")


def test_dense_index(spark, articles):
    order = [seeded_order(4, F.col("article_id")), F.col("article_id")]
    for parts in (1, 6):
        got = sampling.dense_index(articles.repartition(parts), order, "idx")
        rows = {r["article_id"]: r["idx"] for r in got.collect()}
        assert sorted(rows.values()) == list(range(30))
        if parts == 1:
            first = rows
    assert rows == first


def test_pairs(spark, articles):
    order = [seeded_order(4, F.col("article_id")), F.col("article_id")]
    indexed = sampling.dense_index(articles, order, "idx")
    rows = sampling.training_pairs(indexed, 30, 61, 9).collect()
    assert sorted(r["pair_id"] for r in rows) == list(range(61))
    tags = {r["article_id"]: set(r["tags"]) for r in articles.collect()}
    for r in rows:
        if r["pair_id"] % 2 == 0:
            assert r["label"] == 1.0 and r["user_id"] == r["news_id"]
        else:
            assert r["label"] == 0.0 and r["user_id"] != r["news_id"]
            assert not tags[r["user_id"]] & tags[r["news_id"]]
    again = sampling.training_pairs(indexed.repartition(5), 30, 61, 9).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    with pytest.raises(ValueError):
        sampling.training_pairs(indexed, 1, 2, 9)


def test_pairs_fall_back_when_all_share_a_tag(spark):
    rows = [(str(i), ["same"], i) for i in range(6)]
    indexed = spark.createDataFrame(rows, "article_id string, tags array<string>, idx bigint")
    got = sampling.training_pairs(indexed, 6, 12, 1).where("label = 0").collect()
    assert len(got) == 6 and all(r["user_id"] != r["news_id"] for r in got)


def test_random_cap(spark, articles):
    a = sorted(r["article_id"] for r in sampling.random_cap(articles, "article_id", 10, 3).collect())
    b = sorted(r["article_id"] for r in sampling.random_cap(articles.repartition(7), "article_id", 10, 3).collect())
    assert a == b and len(a) == 10
    assert sampling.random_cap(articles, "article_id", None, 3).count() == 30


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(64):
        u = rng.normal(size=WIDTH)
        v = u if i % 2 == 0 else -u
        rows.append((i, u.tolist(), v.tolist(), float(i % 2 == 0)))
    return spark.createDataFrame(rows, "pair_id bigint, user_vec array<float>, news_vec array<float>, label double")


def test_distributed_gradient_is_the_local_one(spark, pairs):
    rows = pairs.collect()
    x = np.array([list(r["user_vec"]) + list(r["news_vec"]) for r in rows])
    ids = np.array([r["pair_id"] for r in rows])
    masks = training.dropout_masks(ids, [16, 8], 1, 3)
    loss, grads = scorer.gradients(params(), x, np.array([r["label"] for r in rows]), masks)
    for parts in (1, 7):
        got, got_loss, n = training.batch_gradient(pairs.repartition(parts), params(), 1, 3)
        assert n == 64 and got_loss == pytest.approx(loss)
        assert np.allclose(got, training.flat(grads), atol=1e-9)


def test_optimiser_steps_by_hand():
    opt = training.AdamW(2)
    start = np.array([1.0, -2.0])
    # The first step of this rule moves by the rate, whatever the gradient's size.
    first = opt.step(start, np.array([0.3, -0.4]), 0.1)
    assert np.allclose(first, start * (1 - 0.1 * 1e-4) - 0.1 * np.array([1.0, -1.0]), atol=1e-6)
    # A long gradient is cut to length one before it enters the means.
    opt = training.AdamW(2)
    opt.step(start, np.array([30.0, -40.0]), 0.1)
    assert np.allclose(opt.m, 0.1 * np.array([0.6, -0.8]), atol=1e-6)
    assert training.cosine_rate(0, 2) == pytest.approx(1e-3)
    assert training.cosine_rate(1, 2) == pytest.approx(5e-4)


def test_dropout_rates():
    masks = training.dropout_masks(np.arange(4000), [16, 8], 0, 0)
    assert (masks[0] == 0).mean() == pytest.approx(0.3, abs=0.02)
    assert (masks[1] == 0).mean() == pytest.approx(0.2, abs=0.02)
    assert masks[0].max() == pytest.approx(1 / 0.7)


def test_shuffle_is_a_permutation(spark):
    for n in (1, 2, 30, 64):
        for epoch in range(3):
            got = spark.range(n).select(training.shuffled("id", n, epoch, 1).alias("p")).collect()
            assert sorted(r["p"] for r in got) == list(range(n))


def _local_fit(rows, epochs, batch, rate, seed, n):
    """The same descent, one mini-batch after the other in one place."""
    rows = {r["pair_id"]: r for r in rows}
    weights, opt, losses = training.flat(params()), training.AdamW(training.flat(params()).size), []
    for epoch in range(epochs):
        rng = np.random.Generator(np.random.PCG64([seed, epoch]))
        factor = int(rng.integers(1, n))
        while np.gcd(factor, n) != 1:
            factor = factor % n + 1
        shift, total = int(rng.integers(0, n)), 0.0
        order = sorted(rows, key=lambda i: (i * factor + shift) % n)
        for at in range(0, n, batch):
            some = [rows[i] for i in order[at : at + batch]]
            x = np.float32([list(r["user_vec"]) + list(r["news_vec"]) for r in some]).astype(float)
            ids = np.array([r["pair_id"] for r in some])
            masks = training.dropout_masks(ids, [16, 8], epoch, seed)
            labels = np.array([r["label"] for r in some])
            loss, grads = scorer.gradients(training.unflat(weights, params()), x, labels, masks)
            weights = opt.step(weights, training.flat(grads) / len(some), training.cosine_rate(epoch, epochs, rate))
            total += loss
        losses.append(total / n)
    return weights, losses


@pytest.mark.parametrize("batch,a_task", [(7, 4096), (16, 4096), (20, 7), (64, 16), (7, 2)])
def test_fit_is_the_local_descent(spark, pairs, monkeypatch, batch, a_task):
    """In one task, in several that gather, and in a job per step."""
    monkeypatch.setattr(training, "PAIRS_A_TASK", a_task)
    tasks = training.barrier_tasks(batch, training.flat(params()).size, 4)
    assert tasks == {(7, 4096): 1, (16, 4096): 1, (20, 7): 3, (64, 16): 4, (7, 2): 4}[batch, a_task]
    want, losses = _local_fit(pairs.collect(), 2, batch, 0.02, 2, 64)
    fitted = training.fit(pairs.repartition(5), 64, params(), 2, batch, 0.02, 2)
    assert np.allclose(fitted.losses, losses, atol=1e-9, rtol=0)
    assert np.allclose(training.flat(fitted.params), want, atol=1e-9, rtol=0)


def test_large_batches_take_a_job_per_step(pairs, monkeypatch):
    gathered = training.fit(pairs, 64, params(), 1, 32, 0.02, 2)
    monkeypatch.setattr(training, "GATHERED_BYTES", 0)
    monkeypatch.setattr(training, "PAIRS_A_TASK", 16)
    assert training.barrier_tasks(32, 1000, 4) == 0
    by_jobs = training.fit(pairs, 64, params(), 1, 32, 0.02, 2)
    assert np.allclose(gathered.losses, by_jobs.losses, atol=1e-9, rtol=0)
    assert np.allclose(training.flat(gathered.params), training.flat(by_jobs.params), atol=1e-9, rtol=0)


def test_fit_goes_on_behind_the_last_epoch(pairs, tmp_path, monkeypatch):
    whole = training.fit(pairs, 64, params(), 3, 16, 0.02, 2)
    folder, ran = str(tmp_path / "fit"), []
    stage = training._epoch_in_stage

    def dies(*plan):
        if len(ran) == 2:
            raise RuntimeError("lost")
        ran.append(plan[4])
        return stage(*plan)

    monkeypatch.setattr(training, "_epoch_in_stage", dies)
    with pytest.raises(RuntimeError):
        training.fit(pairs, 64, params(), 3, 16, 0.02, 2, checkpoint=folder)
    monkeypatch.setattr(training, "_epoch_in_stage", lambda *plan: ran.append(plan[4]) or stage(*plan))
    again = training.fit(pairs, 64, params(), 3, 16, 0.02, 2, checkpoint=folder)
    assert ran == [0, 1, 2]
    assert np.array_equal(training.flat(again.params), training.flat(whole.params)) and again.losses == whole.losses
    with pytest.raises(ValueError):
        training.fit(pairs, 64, params(), 3, 8, 0.02, 2, checkpoint=folder)


def test_loss_falls(pairs):
    fitted = training.fit(pairs, 64, params(), epochs=4, batch=16, rate=0.02, seed=2, dropout=False)
    assert fitted.losses[-1] < fitted.losses[0]


def test_refit_warm_starts_and_versions(spark, tmp_path):
    root = str(tmp_path / "model")
    rows = [(str(i), f"title {i}", f"text {i}", f'["t{i % 3}"]', 100 + i) for i in range(12)]
    df = spark.createDataFrame(
        rows, "id string, title string, introductory_paragraph string, tags string, published_time_unix bigint"
    )
    encoder = embedding.HashingEncoder(WIDTH)
    first, mark = training.refit(df, encoder, root, "1", n_pairs=10, epochs=1, batch=10)
    assert mark == 111
    assert training.refit(df, encoder, root, "2") is None
    assert load_mark(spark, root) == mark
    later = df.withColumn("published_time_unix", F.col("published_time_unix") + 12)
    second, mark = training.refit(later, encoder, root, "2", since=111, n_pairs=10, epochs=1, batch=10)
    assert mark == 123
    newest = load_model(spark, root, WIDTH)
    assert np.allclose(newest["w0"], second.params["w0"])
    moved = np.abs(second.params["w0"] - first.params["w0"]).max()
    assert 0 < moved < 0.01


def test_a_step_makes_no_copy_of_the_moments_and_the_same_update():
    rng = np.random.default_rng(1)
    params, grads = rng.normal(size=20_001), rng.normal(size=(5, 20_001))
    got, optimiser = params, training.AdamW(20_001)
    m, v, held = np.zeros(20_001), np.zeros(20_001), optimiser.m
    for t, grad in enumerate(grads, 1):
        got = optimiser.step(got, grad, 0.01)
        g = grad * min(1.0, training.CLIP / (float(np.sqrt((grad * grad).sum())) + 1e-6))
        m, v = 0.9 * m + (1 - 0.9) * g, 0.999 * v + (1 - 0.999) * g * g
        move = 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + training.ADAM_EPS)
        params = params * (1 - 0.01 * training.DECAY) - move
        assert (got == params).all()
    assert optimiser.m is held


def test_dropout_keeps_the_shares_of_the_mixed_numbers():
    ids, shares = np.arange(40), (0.3, 0.2)
    for layer, (mask, share) in enumerate(zip(training.dropout_masks(ids, [64, 16], 1, 5), shares, strict=True)):
        rows = training._mixed(ids, 1 + 5 + 1000 + 100 * layer)[:, None]
        u = training._mixed(rows + np.arange(mask.shape[1], dtype=np.uint64), 2).astype(np.float64) / 2.0**64
        assert (mask == (u >= share) / (1.0 - share)).all()
    assert float(training._least(0.3)) / 2.0**64 >= 0.3 > float(int(training._least(0.3)) - 1) / 2.0**64
