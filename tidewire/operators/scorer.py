"""The neural relevance scorer: weights, forward pass and gradients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Widths of the hidden layers, dropout of the first two, and the
# constants of layer normalisation.
HIDDEN = (512, 128, 32)
DROPOUT = (0.3, 0.2)
NORM_EPS = 1e-5
NORMED = (True, True, False)


class Scorer(Protocol):
    width: int

    def score(self, user: np.ndarray, news: np.ndarray) -> np.ndarray: ...


def seeded_uniform(seed: int, layer: int, rows: int, cols: int) -> np.ndarray:
    """Numbers in [0, 1) from the MD5 of ``seed:layer:row:col``."""
    def unit(i: int, j: int) -> float:
        return int(hashlib.md5(f"{seed}:{layer}:{i}:{j}".encode()).hexdigest()[:8], 16) / 2**32

    return np.array([[unit(i, j) for j in range(cols)] for i in range(rows)])


Params = dict[str, np.ndarray]


def initial_params(width: int, seed: int = 0, hidden: tuple[int, ...] = HIDDEN) -> Params:
    """Xavier-uniform weights, zero biases, unit scales; a function of the seed."""
    sizes = [2 * width, *hidden, 1]
    params: Params = {}
    for layer, (fan_in, fan_out) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        limit = np.sqrt(6.0 / (fan_in + fan_out))
        params[f"w{layer}"] = limit * (2.0 * seeded_uniform(seed, layer, fan_out, fan_in) - 1.0)
        params[f"b{layer}"] = np.zeros(fan_out)
        if layer < len(hidden) and NORMED[layer]:
            params[f"g{layer}"] = np.ones(fan_out)
            params[f"h{layer}"] = np.zeros(fan_out)
    return params


def layer_count(params: Params) -> int:
    return sum(1 for name in params if name.startswith("w"))


def _normed(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centred = z - z.mean(axis=1, keepdims=True)
    scale = 1.0 / np.sqrt((centred * centred).mean(axis=1, keepdims=True) + NORM_EPS)
    centred *= scale
    return centred, scale


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1.0 / (1.0 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1.0 + np.exp(-np.abs(z))))


def forward(params: Params, x: np.ndarray, masks: list[np.ndarray] | None = None, first: np.ndarray | None = None):
    """Scores of a batch, and what the backward pass needs.

    ``first`` is the product of the first layer when it is known already;
    ``masks`` are dropout multipliers, absent in evaluation.
    """
    last = layer_count(params) - 1
    kept, a = [], x
    for layer in range(last + 1):
        z = first if layer == 0 and first is not None else a @ params[f"w{layer}"].T
        z = z + params[f"b{layer}"] if z is first else np.add(z, params[f"b{layer}"], out=z)
        step = {"in": a}
        if layer == last:
            kept.append(step)
            return sigmoid(z[:, 0]), kept
        if f"g{layer}" in params:
            step["unit"], step["scale"] = _normed(z)
            z = step["unit"] * params[f"g{layer}"]
            z += params[f"h{layer}"]
        # what passes a unit, and by what factor: negative values do not, nor dropped ones
        step["gate"] = z > 0
        if masks is not None and layer < len(masks):
            step["gate"] = step["gate"] * masks[layer]
            a = np.multiply(z, step["gate"], out=z)
        else:
            a = np.fmax(z, 0.0, out=z)
        kept.append(step)
    raise AssertionError("the last layer returns")


def gradients(params: Params, x: np.ndarray, label: np.ndarray, masks=None) -> tuple[float, Params]:
    """Summed cross-entropy of a batch and its gradient."""
    score, kept = forward(params, x, masks)
    safe = np.clip(score, 1e-12, 1.0 - 1e-12)
    loss = -(label * np.log(safe) + (1.0 - label) * np.log(1.0 - safe)).sum()
    grads: Params = {}
    delta = (score - label)[:, None]
    for layer in range(len(kept) - 1, -1, -1):
        step = kept[layer]
        if layer < len(kept) - 1:
            delta *= step["gate"]
            if "unit" in step:
                grads[f"g{layer}"] = (delta * step["unit"]).sum(axis=0)
                grads[f"h{layer}"] = delta.sum(axis=0)
                delta *= params[f"g{layer}"]
                along = step["unit"] * (delta * step["unit"]).mean(axis=1, keepdims=True)
                delta -= delta.mean(axis=1, keepdims=True)
                delta -= along
                delta *= step["scale"]
        grads[f"w{layer}"] = delta.T @ step["in"]
        grads[f"b{layer}"] = delta.sum(axis=0)
        if layer:
            delta = delta @ params[f"w{layer}"]
    return float(loss), grads


@dataclass(frozen=True)
class NeuralScorer:
    """The scorer with given weights, in evaluation mode."""

    params: Params

    @property
    def width(self) -> int:
        return self.params["w0"].shape[1] // 2

    def score(self, user: np.ndarray, news: np.ndarray) -> np.ndarray:
        """Scores of row-wise pairs.

        The first layer is a sum of a user part and a news part. Rows of one user
        come together, so each run of equal users is multiplied once.
        """
        w = self.params["w0"]
        starts = np.r_[True, (user[1:] != user[:-1]).any(axis=1)]
        users = user[starts] @ w[:, : self.width].T
        first = users[np.cumsum(starts) - 1] + news @ w[:, self.width :].T
        return forward(self.params, None, first=first)[0]


@dataclass(frozen=True)
class DotScorer:
    """A stand-in that needs no weights: half of one plus the dot product."""

    width: int

    def score(self, user: np.ndarray, news: np.ndarray) -> np.ndarray:
        return 0.5 * (1.0 + np.einsum("ij,ij->i", user, news))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if not (sizes == width).all():
        raise ValueError(f"the scorer takes vectors of width {width}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def score_candidates(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``neural_score`` to rows that carry ``user_vec`` and ``news_vec``.

    The vectors are dropped. The scorer is of fixed size and travels with the
    function, which Spark sends once per executor when it is large.
    """
    kept = [c for c in pairs.columns if c not in ("user_vec", "news_vec")]
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in kept
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = scorer.score(
                _matrix(batch.column("user_vec"), scorer.width),
                _matrix(batch.column("news_vec"), scorer.width),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(score, pa.float64())],
                names=[*kept, "neural_score"],
            )

    return pairs.mapInArrow(run, f"{schema}, neural_score double")
