"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import materialise

# A hot key owns more than one row in HOT_SHARE, so there are fewer than
# HOT_SHARE hot keys whatever the size of the table: that bounds the broadcast.
# Below MIN_PIECE rows a key is never worth cutting.
HOT_SHARE = 1000
MIN_PIECE = 10_000
# Rows of ids, and at most a number beside them, up to which they are broadcast:
# some tens of megabytes.
BROADCAST_ROWS = 500_000
_SALT = "_salt"
_COPIES = "_copies"


def sized(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Narrow rows, counted, and marked for broadcast if they are few.

    Estimates of an aggregate or a join follow the size of their input, so
    without a count the planner would shuffle a whole table to meet a few ids.
    """
    kept = materialise(ids)
    return few(kept, kept.count(), most)


def few(kept: DataFrame, n: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of so many narrow rows, marked for broadcast if they are few."""
    return F.broadcast(kept) if n <= most else kept


def hot_keys(
    df: DataFrame, key: str, share: int = HOT_SHARE, min_piece: int = MIN_PIECE
) -> DataFrame | None:
    """The hot keys of a table and the number of pieces to cut each into.

    Rows are counted per key with map-side partial sums, and the total comes in
    as a scalar subquery. Fewer than ``share`` rows reach the driver, by the
    definition of a hot key; None means that no key is hot.
    """
    keyed = df.where(F.col(key).isNotNull())
    total = keyed.agg(F.count("*")).scalar()
    piece = F.greatest(total / share, F.lit(min_piece))
    counts = keyed.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > piece).select(
        key, F.ceil(F.col("_n") / piece).cast("int").alias(_COPIES)
    )
    found = hot.collect()
    return df.sparkSession.createDataFrame(found, hot.schema) if found else None


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_by: list[str],
    hot: DataFrame | None,
) -> DataFrame:
    """Equi-join of many rows to a table with one row per key.

    Rows of a hot key spread over its pieces by the hash of ``spread_by``; the
    one matching row on the right is repeated once per piece. Other keys join as
    they are, and a null key keeps salt zero, so no row is lost.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type {how}")
    if hot is None:
        return left.join(right, key, how)
    small = F.broadcast(hot)
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.col(_COPIES)).cast("int")
    salted = left.join(small, key, "left").withColumn(_SALT, F.coalesce(piece, F.lit(0)))
    pieces = F.sequence(F.lit(0), F.coalesce(F.col(_COPIES), F.lit(1)) - 1)
    repeated = right.join(small, key, "left").withColumn(_SALT, F.explode(pieces))
    return salted.drop(_COPIES).join(repeated.drop(_COPIES), [key, _SALT], how).drop(_SALT)
