"""Score arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below the threshold the neural score counts as untrained and
# weighs less; otherwise both halves weigh the same.
UNTRAINED_BELOW = 0.01
UNTRAINED_WEIGHTS = (0.8, 0.2)
TRAINED_WEIGHTS = (0.5, 0.5)
SCORE_PLACES = 6


def blend(retrieval: Column, neural: Column) -> Column:
    q = F.coalesce(retrieval.cast("double"), F.lit(0.0))
    n = neural.cast("double")
    low_q, low_n = UNTRAINED_WEIGHTS
    q_share, n_share = TRAINED_WEIGHTS
    mixed = F.when(n < UNTRAINED_BELOW, q * low_q + n * low_n).otherwise(q * q_share + n * n_share)
    return F.round(mixed, SCORE_PLACES)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def match_percent(score: Column) -> Column:
    return F.round(score * 100, 1)
