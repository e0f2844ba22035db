"""Fitting the scorer: distributed gradients, one update per mini-batch.

An epoch is one barrier stage. Its tasks hold the pairs of every mini-batch between
them, in step order, gather each other's gradient sums at every step, add them up in
the order of the tasks and make the same update, so no step is a job of its own. A
gradient has the size of the model and every task gets them all: the number of tasks
follows from the batch, up to what one message may carry. A batch past that is summed
by a job per step, whose cost its size then outweighs.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.ids import seeded_order
from tidewire.functions.text import news_embedding_text, parse_tags
from tidewire.operators.embedding import Encoder, embed
from tidewire.operators.sampling import dense_index, random_cap, training_pairs
from tidewire.operators.scorer import DROPOUT, Params, forward, gradients, initial_params
from tidewire.session import materialise, work_dir
from tidewire.sources.readers import training_articles
from tidewire.sources.tables import load_mark, load_model, read_if_there, save_model

# Fixed values of the optimiser.
RATE = 1e-3
DECAY = 1e-4
BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8
CLIP = 1.0
PAIRS, EPOCHS, BATCH, ARTICLES = 2000, 2, 128, 500
_PART = 1 << 14
_PORTION = 1 << 13
_SUM_FAN_IN = 32
#: Pairs of a mini-batch that one barrier task takes, and bytes of gradients that
#: all tasks of a step may send each other: half of what a message of Spark may hold.
PAIRS_A_TASK = 4096
GATHERED_BYTES = 64 << 20
_EPOCH = "epoch int, setting string, weights binary, mean binary, spread binary, turns long, loss double, rows long"


@dataclass
class Fitted:
    params: Params
    losses: list[float]


def flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflat(vector: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Well-spread 64-bit numbers from whole numbers."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        return z


@cache
def _least(share: float) -> np.uint64:
    """The smallest 64-bit number that is at least that share of 2^64, as a float."""
    low, high = 0, (1 << 64) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if float(middle) / 2.0**64 >= share else (middle + 1, high)
    return np.uint64(low)


def dropout_masks(pair_ids: np.ndarray, widths: list[int], epoch: int, seed: int) -> list[np.ndarray]:
    """Dropout multipliers that depend on seed, epoch and pair only, so the
    result is the same however the pairs are partitioned."""
    masks = []
    for layer, (share, width) in enumerate(zip(DROPOUT, widths, strict=False)):
        rows = _mixed(pair_ids, 1 + seed + 1000 * epoch + 100 * layer)[:, None]
        units = np.arange(width, dtype=np.uint64)[None, :]
        masks.append((_mixed(rows + units, 2) >= _least(share)) * (1 / (1.0 - share)))
    return masks


def shuffled(pair: str, n: int, epoch: int, seed: int):
    """A new order of 0 … n-1 per epoch, by a map that hits each number once."""
    rng = np.random.Generator(np.random.PCG64([seed, epoch]))
    factor = int(rng.integers(1, n)) if n > 1 else 1
    while math.gcd(factor, n) != 1:
        factor = factor % n + 1
    shift = int(rng.integers(0, n))
    product = (F.col(pair).cast("decimal(38,0)") * F.lit(factor) + F.lit(shift)) % F.lit(n)
    return product.cast("bigint")


def _summed_rows(batch: pa.RecordBatch, params: Params, widths: list[int], epoch: int, seed: int, dropout: bool):
    """Gradient as one vector, and loss, summed over some pairs."""
    width = params["w0"].shape[1] // 2
    both = [
        batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for c in ("user_vec", "news_vec")
    ]
    x = np.concatenate(both, axis=1).astype(np.float64)
    pair_ids = batch.column("pair_id").to_numpy()
    masks = dropout_masks(pair_ids, widths, epoch, seed) if dropout else None
    loss, grads = gradients(params, x, batch.column("label").to_numpy(), masks)
    return flat(grads), loss


def _gradient_parts(sent, widths: list[int], epoch: int, seed: int, dropout: bool):
    """Summed gradient of the rows of a task, cut into parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = sent.value
        total, loss, rows = None, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vector, step_loss = _summed_rows(batch, params, widths, epoch, seed, dropout)
            total = vector if total is None else total + vector
            loss, rows = loss + step_loss, rows + batch.num_rows
        if total is None:
            return
        packed = np.concatenate([total, [loss, rows]])
        parts = [packed[at : at + _PART] for at in range(0, len(packed), _PART)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(parts), dtype=np.int32)),
                pa.array([p.tobytes() for p in parts], pa.binary()),
            ],
            names=["part", "piece"],
        )

    return run


def _summed(group: pa.Table) -> pa.Table:
    pieces = [np.frombuffer(b) for b in group.column("piece").to_pylist()]
    return pa.table(
        {
            "part": pa.array([group.column("part")[0].as_py()], pa.int32()),
            "piece": pa.array([np.sum(pieces, axis=0).tobytes()], pa.binary()),
        }
    )


def batch_gradient(
    rows: DataFrame, params: Params, epoch: int, seed: int, dropout: bool = True
) -> tuple[np.ndarray, float, int]:
    """Gradient, loss and row count, summed over a mini-batch on the cluster.

    A task sends one gradient, whose size is that of the model, in parts. Parts
    are summed in two rounds, so that a group never holds more than a few. The
    driver gets one summed gradient.
    """
    widths = [params["w0"].shape[0], params["w1"].shape[0]]
    sent = rows.sparkSession.sparkContext.broadcast(params)
    schema = "part int, piece binary"
    parts = rows.select("pair_id", "user_vec", "news_vec", "label").mapInArrow(
        _gradient_parts(sent, widths, epoch, seed, dropout), schema
    )
    fan = F.pmod(F.spark_partition_id(), F.lit(_SUM_FAN_IN)).alias("fan")
    some = parts.select(fan, "part", "piece").groupBy("part", "fan").applyInArrow(_summed, schema)
    summed = some.groupBy("part").applyInArrow(_summed, schema).collect()
    sent.unpersist()
    packed = np.concatenate([np.frombuffer(r["piece"]) for r in sorted(summed, key=lambda r: r["part"])])
    return packed[:-2], float(packed[-2]), int(packed[-1])


class AdamW:
    """Decoupled weight decay, with the norm of the gradient clipped."""

    def __init__(self, size: int):
        self.m = np.zeros(size)
        self.v = np.zeros(size)
        self.t = 0

    def step(self, params: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        """New weights. The moments are updated in place, in portions that stay in the cache."""
        length = float(np.sqrt((grad * grad).sum()))
        clip = min(1.0, CLIP / (length + 1e-6))
        self.t += 1
        first, second = BETAS
        out = np.empty_like(params)
        for at in range(0, len(params), _PORTION):
            part = slice(at, at + _PORTION)
            g = grad[part] * clip
            m, v = self.m[part], self.v[part]
            m *= first
            m += (1 - first) * g
            v *= second
            square = (1 - second) * g
            square *= g
            v += square
            spread = np.divide(v, 1 - second**self.t, out=square)
            np.sqrt(spread, out=spread)
            spread += ADAM_EPS
            move = np.divide(m, 1 - first**self.t, out=g)
            move *= rate
            move /= spread
            np.multiply(params[part], 1 - rate * DECAY, out=out[part])
            out[part] -= move
        return out


def cosine_rate(epoch: int, epochs: int, rate: float = RATE) -> float:
    """Rate of an epoch, from 0, on a half cosine."""
    return rate * (1 + math.cos(math.pi * epoch / epochs)) / 2


@dataclass
class _Progress:
    """Weights and optimiser after some epochs, and what the last one cost."""

    weights: np.ndarray
    optimiser: AdamW
    losses: list[float]


def _steps(batches: Iterable[pa.RecordBatch], batch: int, n_steps: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of step 0, 1, 2 ... in turn, as pieces; rows come in step order."""
    step, held = 0, []
    for rows in batches:
        steps = rows.column("place").to_numpy() // batch
        cuts = np.flatnonzero(np.diff(steps)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(steps)], strict=True):
            if start == stop:
                continue
            while step < steps[start]:
                yield held
                step, held = step + 1, []
            held.append(rows.slice(start, stop - start))
    for _ in range(step, n_steps):
        yield held
        held = []


def _epoch_in_stage(
    pairs: DataFrame, n_pairs: int, params: Params, now: _Progress, epoch: int, batch: int, rate: float, seed: int,
    dropout: bool, tasks: int,
) -> tuple[_Progress, float, int]:
    """One epoch as one barrier stage; every task makes every update."""
    widths = [params["w0"].shape[0], params["w1"].shape[0]]
    shapes = {k: v.shape for k, v in params.items()}
    n_steps = math.ceil(n_pairs / batch)
    spark = pairs.sparkSession
    sent = spark.sparkContext.broadcast((now.weights, now.optimiser.m, now.optimiser.v, now.optimiser.t))
    place = shuffled("pair_id", n_pairs, epoch, seed)
    dealt = pairs.select("pair_id", "user_vec", "news_vec", "label", place.alias("place"))
    if tasks == 1:
        dealt = dealt.repartition(1)
    else:
        share = F.floor(F.col("place") % batch * tasks / batch)
        dealt = dealt.repartitionByRange(tasks, share)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        like = {k: np.empty(s) for k, s in shapes.items()}
        optimiser = AdamW(0)
        weights, mean, spread, optimiser.t = sent.value
        optimiser.m, optimiser.v = mean.copy(), spread.copy()
        total, seen = 0.0, 0
        for rows in _steps(batches, batch, n_steps):
            packed = np.zeros(len(weights) + 2)
            params = unflat(weights, like)
            for some in rows:
                vector, loss = _summed_rows(some, params, widths, epoch, seed, dropout)
                packed[:-2] += vector
                packed[-2:] += loss, some.num_rows
            if tasks > 1:
                said = context.allGather(base64.b64encode(packed.tobytes()).decode() if rows else "")
                packed = np.sum([np.frombuffer(base64.b64decode(m)) for m in said if m], axis=0)
            if packed[-1]:
                weights = optimiser.step(weights, packed[:-2] / packed[-1], rate)
                total, seen = total + packed[-2], seen + int(packed[-1])
        if context.partitionId() == 0:
            arrays = [v.tobytes() for v in (weights, optimiser.m, optimiser.v)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([a], pa.binary()) for a in arrays], pa.array([optimiser.t]), pa.array([total]), pa.array([seen])],
                names=["weights", "mean", "spread", "turns", "loss", "rows"],
            )

    schema = "weights binary, mean binary, spread binary, turns long, loss double, rows long"
    found = dealt.sortWithinPartitions("place").mapInArrow(run, schema, barrier=True).collect()[0]
    sent.unpersist()
    return _restored(found, now.losses), found["loss"], found["rows"]


def _restored(row, losses: list[float]) -> _Progress:
    optimiser = AdamW(len(row["mean"]) // 8)
    optimiser.m, optimiser.v = np.frombuffer(row["mean"]).copy(), np.frombuffer(row["spread"]).copy()
    optimiser.t = row["turns"]
    return _Progress(np.frombuffer(row["weights"]), optimiser, losses)


def _epoch_in_jobs(
    pairs: DataFrame, n_pairs: int, params: Params, now: _Progress, epoch: int, batch: int, rate: float, seed: int,
    dropout: bool,
) -> tuple[_Progress, float, int]:
    """One epoch as a job per step, for batches too large to gather gradients.

    The pairs are laid out in step order, once; a step reads its own row groups by
    filter pushdown.
    """
    path = work_dir(pairs.sparkSession, f"epoch-{epoch}")
    place = shuffled("pair_id", n_pairs, epoch, seed)
    dealt = pairs.withColumn("place", place).withColumn("step", F.floor(F.col("place") / batch))
    dealt.repartitionByRange("place").sortWithinPartitions("place").write.parquet(path)
    laid_out = pairs.sparkSession.read.parquet(path)
    total, seen = 0.0, 0
    for step in range(math.ceil(n_pairs / batch)):
        grad, loss, rows = batch_gradient(
            laid_out.where(F.col("step") == step), unflat(now.weights, params), epoch, seed, dropout
        )
        now.weights = now.optimiser.step(now.weights, grad / rows, rate)
        total, seen = total + loss, seen + rows
    return now, total, seen


def barrier_tasks(batch: int, n_params: int, slots: int) -> int:
    """Tasks of a barrier stage; zero if a batch needs more than can be had."""
    message = 8 * (n_params + 2) * 4 // 3
    most = max(1, min(slots, GATHERED_BYTES // message))
    wanted = max(1, math.ceil(batch / PAIRS_A_TASK))
    return wanted if wanted <= most else 0


def _setting(n_pairs: int, params: Params, epochs: int, batch: int, rate: float, seed: int, dropout: bool) -> str:
    return repr((n_pairs, flat(params).size, epochs, batch, rate, seed, dropout))


def _resumed(spark: SparkSession, folder: str, setting: str, start: _Progress) -> tuple[int, _Progress]:
    """The last epoch that a folder holds and what it left; the start if it holds none."""
    kept = read_if_there(spark, folder, _EPOCH)
    rows = [] if kept is None else kept.select("epoch", "setting", "loss", "rows").orderBy("epoch").collect()
    if not rows:
        return 0, start
    if any(r["setting"] != setting for r in rows):
        raise ValueError(f"{folder} holds epochs of another fit")
    last = kept.where(F.col("epoch") == rows[-1]["epoch"]).first()
    return last["epoch"] + 1, _restored(last, [r["loss"] / r["rows"] for r in rows])


def fit(
    pairs: DataFrame,
    n_pairs: int,
    params: Params,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    rate: float = RATE,
    seed: int = 0,
    dropout: bool = True,
    checkpoint: str | None = None,
) -> Fitted:
    """Mini-batch descent over pairs numbered 0 … n-1.

    Each epoch deals the pairs anew into mini-batches. ``checkpoint`` names a folder,
    new for each fit, that gets the weights and the optimiser after every epoch; a fit
    that finds epochs of its own there goes on behind them.
    """
    spark = pairs.sparkSession
    now = _Progress(flat(params), AdamW(flat(params).size), [])
    setting = _setting(n_pairs, params, epochs, batch, rate, seed, dropout)
    first = 0
    if checkpoint:
        first, now = _resumed(spark, checkpoint, setting, now)
    tasks = barrier_tasks(batch, now.weights.size, spark.sparkContext.defaultParallelism)
    for epoch in range(first, epochs):
        plan = (pairs, n_pairs, params, now, epoch, batch, cosine_rate(epoch, epochs, rate), seed, dropout)
        now, total, seen = _epoch_in_stage(*plan, tasks) if tasks else _epoch_in_jobs(*plan)
        now.losses = [*now.losses, total / seen]
        if checkpoint:
            arrays = [bytearray(v.tobytes()) for v in (now.weights, now.optimiser.m, now.optimiser.v)]
            row = (epoch, setting, *arrays, now.optimiser.t, float(total), seen)
            one = spark.createDataFrame([row], _EPOCH).coalesce(1)
            one.write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}/fitted={epoch}")
    return Fitted(unflat(now.weights, params), now.losses)


def pairs_with_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs and the two vectors of each. Articles are drawn uniformly, so no key
    of these joins stands out."""
    user = vectors.select(F.col("article_id").alias("user_id"), F.col("vec").alias("user_vec"))
    news = vectors.select(F.col("article_id").alias("news_id"), F.col("vec").alias("news_vec"))
    return pairs.join(user, "user_id").join(news, "news_id").select(
        "pair_id", "user_vec", "news_vec", "label"
    )


def mean_losses(pairs: DataFrame, params: Params) -> DataFrame:
    """(label, pairs, mean_loss) of a scorer as it stands, without dropout.

    Tasks send a sum per label and batch of rows.
    """

    def losses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = params["w0"].shape[1] // 2
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [
                batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("user_vec", "news_vec")
            ]
            score, _ = forward(params, np.concatenate(both, axis=1).astype(np.float64))
            label = batch.column("label").to_numpy()
            hit = np.clip(np.where(label == 1, score, 1 - score), 1e-12, 1.0)
            kinds = np.unique(label)
            sums = [-np.log(hit[label == k]).sum() for k in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(sums, pa.float64()), pa.array([int((label == k).sum()) for k in kinds], pa.int64())],
                names=["label", "loss", "n"],
            )

    summed = pairs.select("user_vec", "news_vec", "label").mapInArrow(losses, "label double, loss double, n long")
    return summed.groupBy("label").agg(F.sum("n").alias("pairs"), (F.sum("loss") / F.sum("n")).alias("mean_loss"))


def fit_on_articles(
    articles: DataFrame,
    params: Params,
    n_pairs: int = PAIRS,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    rate: float = RATE,
    seed: int = 0,
    max_articles: int | None = ARTICLES,
) -> Fitted:
    """Fit on pairs drawn from articles with ``article_id``, ``tags``, ``vec``."""
    chosen = materialise(random_cap(articles, "article_id", max_articles, seed))
    n = chosen.count()
    order = [seeded_order(seed, F.col("article_id")), F.col("article_id")]
    indexed = dense_index(chosen.select("article_id", "tags"), order, "idx")
    n_pairs = min(n_pairs, 2 * n)
    pairs = pairs_with_vectors(training_pairs(indexed, n, n_pairs, seed), chosen)
    return fit(materialise(pairs), n_pairs, params, epochs, batch, rate, seed)


def refit(
    articles: DataFrame,
    encoder: Encoder,
    model_root: str,
    version: str,
    since: int | None = None,
    n_pairs: int = PAIRS,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    seed: int = 0,
    max_articles: int | None = ARTICLES,
) -> tuple[Fitted, int] | None:
    """Fine-tune the newest model on articles past the mark; save a new version.

    Starts from seeded weights when there is no model yet. The mark, a publish time, is
    kept with the version and read from the newest one unless ``since`` is given.
    Returns the fit and the new mark; None when nothing is new.
    """
    spark = articles.sparkSession
    if since is None:
        since = load_mark(spark, model_root)
    fresh = articles.where(F.col("published_time_unix") > since)
    top = fresh.agg(F.max("published_time_unix")).first()[0]
    if top is None:
        return None
    chosen = random_cap(training_articles(fresh), "id", max_articles, seed)
    texts = chosen.select(
        F.col("id").alias("article_id"),
        parse_tags(F.col("tags")).alias("tags"),
        news_embedding_text(F.col("title"), F.col("introductory_paragraph")).alias("text"),
    )
    embedded = embed(texts, {"vec": F.col("text")}, encoder).drop("text")
    params = load_model(spark, model_root, encoder.width) or initial_params(encoder.width, seed)
    fitted = fit_on_articles(
        embedded, params, n_pairs, epochs, batch, seed=seed, max_articles=None
    )
    save_model(spark, model_root, version, fitted.params, top)
    return fitted, top
