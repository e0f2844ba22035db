"""Connected components of links, as alternating joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node with a link; the label is the least node reached.

    ``links`` has ``a`` and ``b``. Each round hooks the larger neighbours of every
    node to its least one, then the smaller ones, so that chains halve; it ends when
    all edges point to a least node. Groups are never gathered: a round is a minimum
    per node and a join with it, and its edges are written to the shared folder.
    """
    edges = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}0",
    )
    state, turn = _state(edges), 0
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lower.select("u", "m")).distinct()
        )
        turn += 1
        edges = scratch.keep(small, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        roots.select("v", F.col("v").alias("label"))
    )
