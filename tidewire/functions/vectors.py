"""Vector expressions on array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: (x / length).cast("float"))).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, zero when either has no length.

    Row by row, for joins on few rows; ``operators.search`` is the way to
    compare whole tables.
    """
    scale = norm(a) * norm(b)
    return F.when(scale > 0, _dot(a, b) / scale).otherwise(F.lit(0.0))


def is_valid_vector(v: Column, width: int) -> Column:
    """Present, of the exact width, and finite throughout."""
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce((F.size(v) == width) & finite, F.lit(False))


def _none_if_no_items(v: Column) -> Column:
    return F.when(F.size(v) > 0, v)


def scoring_vector(title: Column, description: Column, tags: Column, width: int) -> Column:
    """The title vector, else description, else tags, else zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    present = [_none_if_no_items(v) for v in (title, description, tags)]
    return F.coalesce(*present, zeros)


def projection_matrix(native: int, width: int, seed: int) -> np.ndarray:
    """Xavier-uniform matrix that depends on the seed alone."""
    limit = float(np.sqrt(6.0 / (native + width)))
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.uniform(-limit, limit, size=(native, width)).astype(np.float32)
