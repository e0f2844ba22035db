"""A Merkle manifest of a dataset, whose parents keep the hash states before their slots.

Every row is a leaf, its digest taken by Spark where the text lies, so texts never move.
Leaves of a group are numbered by ranges and dealt in blocks of at most ``BLOCK``
neighbours, which stream through tasks one block at a time. One pass builds the levels
inside all blocks at once; their tops are the leaves of the next pass, so a pass covers
ten levels and few passes serve any group. Groups' tops, in order, are one more such tree.

While a parent is hashed child by child, the state before every slot is copied and
kept. Folding a changed leaf resumes at every level the state that matches its slot,
with the replacement and the siblings to the right only. A state cannot leave its
process, so a block is handed the siblings along its way to the root, and the states
above it are made once per block. Blocks are folded side by side, top pass first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.places import numbered
from tidewire.llm.words import without
from tidewire.session import Scratch

ARITY = 2
#: Leaves of a block; a power of the arity up to this is used.
BLOCK = 1024
RESULT = ["leaf", "subroot", "root", "proof", "folded_root", "verified"]
_WAY = "array<struct<before:string,after:string>>"
#: Rows ahead of a block's leaves: its group has more blocks; what lies above it.
_MORE, _ABOVE = -2, -1


def leaf(columns: list[Column]) -> Column:
    """The digest of some values: ``-`` for null, else byte count, colon and value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Tree:
    """The levels over some digests, with the hash states of all parents.

    ``levels[n]`` are the digests of a level, ``states[n]`` the states before the slots
    of its parents. A last parent may have fewer children, even one. Without ``height``
    the tree ends when one digest is left, else after so many levels.
    """

    def __init__(self, leaves: list[str], arity: int, height: int):
        self.arity, self.levels, self.states = arity, [leaves], []
        for _ in range(height):
            below, above, states = self.levels[-1], [], []
            for i in range(0, len(below), arity):
                parent = hashlib.sha256()
                for child in below[i : i + arity]:
                    states.append(parent.copy())
                    parent.update(child.encode())
                above.append(parent.hexdigest())
            self.levels.append(above)
            self.states.append(states)

    def way(self, at: int) -> list[tuple[str, str]]:
        """The siblings before and after the way up from a leaf, level by level."""
        out = []
        for below in self.levels[:-1]:
            first = at - at % self.arity
            out.append(("".join(below[first:at]), "".join(below[at + 1 : first + self.arity])))
            at //= self.arity
        return out

    def fold(self, at: int, digest: str) -> str:
        """The top digest with another digest at a leaf."""
        for below, states in zip(self.levels[:-1], self.states, strict=True):
            state = states[at].copy()
            state.update((digest + "".join(below[at + 1 : at - at % self.arity + self.arity])).encode())
            digest, at = state.hexdigest(), at // self.arity
        return digest


class Way:
    """Hash states along a way to the root, taken once from the siblings on it."""

    def __init__(self, siblings: list[tuple[str, str]]):
        self.steps = [(hashlib.sha256(before.encode()), after) for before, after in siblings]

    def fold(self, digest: str) -> str:
        for before, after in self.steps:
            state = before.copy()
            state.update((digest + after).encode())
            digest = state.hexdigest()
        return digest


def _rise(n: int, arity: int) -> int:
    """Levels until one of n digests is left."""
    height = 0
    while n > 1:
        n, height = -(-n // arity), height + 1
    return height


def _levels(arity: int, block: int) -> int:
    """Levels whose leaves fit a block; one at least."""
    levels = 1
    while arity ** (levels + 1) <= block:
        levels += 1
    return levels


def _dealt(nodes: DataFrame, size: int, more: list[str], heads: list[DataFrame]) -> DataFrame:
    """(key, block, place, ...) with the leaves of every block together and in order, heads first."""
    rows = nodes.select("key", F.floor(F.col("place") / size).alias("block"), "place", *more)
    beyond = nodes.where(F.col("place") == size).select("key", _long(0).alias("block"), _long(_MORE).alias("place"))
    for head in [beyond, *heads]:
        rows = rows.unionByName(head, allowMissingColumns=True)
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "place")


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), strict=True))
        start = 0
        for i, name in enumerate(names):
            if name != last:
                if last is not None:
                    yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, start, last = [], i, name
        held.append(batch.slice(start))
    if last is not None:
        yield pa.Table.from_batches(held)


def _tree(run: pa.Table, arity: int, levels: int) -> tuple[int, Tree]:
    """Rows ahead of the leaves, and the block's tree: all levels, or up to a lone group's root."""
    first = run.column("place").slice(0, 2).to_pylist()
    heads = sum(x < 0 for x in first)
    digests = run.column("digest").slice(heads).to_pylist()
    whole = run.column("block")[0].as_py() == 0 and _MORE not in first
    return heads, Tree(digests, arity, _rise(len(digests), arity) if whole else levels)


def _build(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(key, place, digest): the tops of all blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            top = _tree(run, arity, levels)[1].levels[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(run.column(c).slice(0, 1).to_pylist(), k) for c, k in (("key", pa.string()), ("block", pa.int64()))]
                + [pa.array(top, pa.string())],
                ["key", "place", "digest"],
            )

    return _dealt(nodes, arity**levels, ["digest"], []).mapInArrow(build, "key string, place long, digest string")


def _fold(nodes: DataFrame, ways: DataFrame, arity: int, levels: int) -> DataFrame:
    """Every node with its whole way up, its group's top and the root from its changed digest.

    ``ways`` has what lies above each block, and the group's top.
    """
    kind = nodes.schema["id"].dataType
    size = arity**levels

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            heads, tree = _tree(run, arity, levels)
            above = [(x["before"], x["after"]) for x in run.column("way")[heads - 1].as_py()]
            top, rest = run.column("top")[heads - 1].as_py(), Way(above)
            before, after, ends, folded = [], [], [0], []
            for at, new in enumerate(run.column("changed").slice(heads).to_pylist()):
                for b, a in (*tree.way(at), *above):
                    before.append(b)
                    after.append(a)
                ends.append(len(before))
                folded.append(None if new is None else rest.fold(tree.fold(at, new)))
            steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
            own = run.slice(heads).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    *[own.column(c).combine_chunks() for c in ("key", "place", "id", "digest")],
                    pa.array([top] * len(own), pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps),
                    pa.array(folded, pa.string()),
                ],
                ["key", "place", "id", "digest", "top", "way", "folded"],
            )

    heads = ways.select("key", "block", _long(_ABOVE).alias("place"), "way", "top")
    rows = _dealt(nodes, size, ["digest", "changed", "id"], [heads])
    return rows.mapInArrow(
        fold, f"key string, place long, id {kind.simpleString()}, digest string, top string, way {_WAY}, folded string"
    )


def _up(scratch: Scratch, nodes: DataFrame, name: str, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (key, place, digest) of every pass, leaves first, and the tops of the groups."""
    passes = [nodes]
    while True:
        tops = scratch.keep(_build(passes[-1], arity, levels), f"{name}{len(passes)}")
        if tops.where("place > 0").isEmpty():
            return passes, tops.select("key", F.col("digest").alias("top"))
        passes.append(tops)


def _down(scratch: Scratch, passes: list[DataFrame], ways: DataFrame, name: str, arity: int, levels: int) -> DataFrame:
    """What ``_fold`` gives for the leaves, with ways handed down from (key, way, top)."""
    ways = ways.withColumn("block", _long(0))
    for turn in range(len(passes) - 1, 0, -1):
        nodes = passes[turn].select("*", F.lit(None).cast("string").alias("changed"), F.lit(None).cast("string").alias("id"))
        done = _fold(nodes, ways, arity, levels)
        ways = scratch.keep(done.select("key", F.col("place").alias("block"), "way", "top"), f"{name}-ways{turn}")
    return _fold(passes[0], ways, arity, levels)


def manifest(
    spark: SparkSession, rows: DataFrame, columns: list[str], group: str, order: str, changed: Column | None = None,
    arity: int = ARITY, block: int = BLOCK,
) -> DataFrame:
    """(order, group) of every row with its leaf, its group's and the whole root, its proof, and a check.

    A leaf is the digest of ``columns``. Leaves of a group go by ``order``, null first,
    equal ones by digest, so repeated rows are leaves of their own; a null group is a
    group, the first one, others go by UTF-8 bytes. ``proof`` holds the siblings before
    and after the row, level by level up to the root. ``changed`` is another digest for
    some rows, null for the others: ``folded_root`` is the root with it, or with the
    row's own leaf, in place, and ``verified`` says that this is the root. Null and
    empty values differ. An empty table has no rows. Other columns are not looked at.
    """
    scratch = Scratch(spark, "merkle")
    levels = _levels(arity, block)
    named = F.col(f"`{group}`")
    own = leaf([F.col(f"`{c}`") for c in columns])
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), named.cast("string")), F.lit("")).alias("key"), F.col(f"`{order}`").alias("by"),
        own.alias("digest"), F.coalesce(own if changed is None else changed, own).alias("changed"),
        F.struct(F.col(f"`{order}`").alias("by"), named.alias("group")).alias("id"),
    )
    placed = numbered(scratch, scratch.keep(leaves, "leaves"), "leaves", ["key"], ["by", "digest"]).drop("by")
    low, tops = _up(scratch, placed, "low", arity, levels)
    whole = tops.select(F.lit("").alias("whole"), F.col("key").alias("id"), "top")
    ranked = numbered(scratch, whole, "groups", ["whole"], ["id"])
    nodes = ranked.select(
        F.col("whole").alias("key"), "place", F.col("top").alias("digest"), "id", F.lit(None).cast("string").alias("changed")
    )
    high, ends = _up(scratch, nodes, "high", arity, levels)
    end = ends.first()
    start = ends.select("key", F.array().cast(_WAY).alias("way"), "top")
    over = _down(scratch, high, start, "high", arity, levels)
    ways = scratch.keep(over.select(F.col("id").alias("key"), "way", F.col("digest").alias("top")), "ways")
    done = _down(scratch, low, ways, "low", arity, levels)
    root = F.lit(end["top"] if end else None).cast("string")
    return done.select(
        F.col("id.by").alias(order), F.col("id.group").alias(group), F.col("digest").alias("leaf"), F.col("top").alias("subroot"),
        root.alias("root"), F.col("way").alias("proof"), F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )
