"""Shards of near equal bytes by best-fit-decreasing packing of indivisible groups.

Rows of one text are a group and stay together. Groups go by decreasing size into the
open shard whose remaining capacity fits most tightly, found in a balanced tree of
shards; a new one opens only where none fits. Equal sizes are interchangeable: the
tightest shard is still the tightest after it has taken one, so it takes as many as it
holds. Packing so needs no groups, only how many there are of each size, and its
result is a few runs per size: the first so many go here, the next so many there.

Different sizes add up to at most the table, so there are fewer than the root of twice
its bytes (14 million at 100 TB, 16 bytes each); they stream through a task in order,
whose memory is the tree of shards. Capacities are tried side by side, a task each.
With a fixed capacity the packing opens as few shards as it can; with a fixed number of
shards the least capacity of a grid is taken that needs no more.

Groups are numbered inside their size by ranges, meet the runs of their size, and their
rows follow them. Texts are read once, where their digest and checksum are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.places import numbered
from tidewire.operators.skew import hot_keys, skew_join
from tidewire.session import Scratch

SHARDS = 8
#: Capacities over the least possible one that are tried, as shares of it.
SLACK = (0.0, *(2.0**-k for k in range(16, 2, -1)))
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


class _Node:
    """A shard in the tree, ordered by what it can still take, then by number."""

    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.height, self.left, self.right = key, 1, None, None


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _turned(node: _Node, light: str, heavy: str) -> _Node:
    """The heavy child on top of its parent."""
    top = getattr(node, heavy)
    setattr(node, heavy, getattr(top, light))
    setattr(top, light, node)
    for n in (node, top):
        n.height = 1 + max(_height(n.left), _height(n.right))
    return top


def _balanced(node: _Node) -> _Node:
    lean = _height(node.left) - _height(node.right)
    if abs(lean) > 1:
        heavy, light = ("left", "right") if lean > 0 else ("right", "left")
        child = getattr(node, heavy)
        if _height(getattr(child, light)) > _height(getattr(child, heavy)):
            setattr(node, heavy, _turned(child, heavy, light))
        return _turned(node, light, heavy)
    node.height = 1 + max(_height(node.left), _height(node.right))
    return node


def _with(node: _Node | None, key: tuple[int, int]) -> _Node:
    if node is None:
        return _Node(key)
    side = "left" if key < node.key else "right"
    setattr(node, side, _with(getattr(node, side), key))
    return _balanced(node)


def _without(node: _Node, key: tuple[int, int]) -> _Node | None:
    if key != node.key:
        side = "left" if key < node.key else "right"
        setattr(node, side, _without(getattr(node, side), key))
        return _balanced(node)
    if not node.left or not node.right:
        return node.left or node.right
    least = node.right
    while least.left:
        least = least.left
    node.key = least.key
    node.right = _without(node.right, least.key)
    return _balanced(node)


class Bins:
    """Open shards of one capacity in a height-balanced tree by remaining room."""

    def __init__(self, capacity: int):
        self.capacity, self.tree, self.opened = capacity, None, 0

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(room, shard) with the least room that takes this size."""
        best, node = None, self.tree
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    def put(self, size: int, n: int) -> Iterator[tuple[int, int]]:
        """(shard, how many) for n groups of a size, as if they came one by one."""
        while n:
            found = self.tightest(size)
            if found:
                self.tree = _without(self.tree, found)
            else:
                found = (max(self.capacity, size), self.opened)
                self.opened += 1
            taken = min(n, found[0] // size)
            self.tree = _with(self.tree, (found[0] - taken * size, found[1]))
            n -= taken
            yield found[1], taken


def pack(sizes: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, size, first, shard) of runs of groups, for every capacity.

    ``sizes`` has ``size`` and ``n``. The groups of a size from ``first`` on, up to the
    next run's, go to the shard. A group over the capacity gets a shard of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bins = ["capacity", "size", "first", "shard"], None
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for capacity, size, n in zip(*(batch.column(c).to_pylist() for c in ("capacity", "size", "n")), strict=True):
                if bins is None or bins.capacity != capacity:
                    bins = Bins(capacity)
                first = 0
                for shard, taken in bins.put(size, n):
                    rows.append((capacity, size, first, shard))
                    first += taken
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    each = F.explode(F.array(*[F.lit(c).cast("long") for c in capacities]))
    tried = sizes.select(each.alias("capacity"), "size", "n")
    dealt = tried.repartition("capacity").sortWithinPartitions("capacity", F.col("size").desc())
    return dealt.mapInArrow(run, "capacity long, size long, first long, shard long")


def shards(
    spark: SparkSession, docs: DataFrame, row_id: str = "doc_id", text: str = "text", n_shards: int | None = SHARDS,
    capacity: int | None = None,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, equal texts together.

    ``size`` is the text's UTF-8 bytes and one more; a null text has none, and size 1.
    Null texts are one group, empty ones another. With ``capacity`` the number of
    shards follows, as few as the packing finds; without it there are at most
    ``n_shards``, as even as the grid of capacities and the largest group allow. ``slot``
    numbers the rows of a shard from 0, by text and id; repeated rows have slots of
    their own. The law is ``bytes``, so ``grown_shard`` is null. Other columns are not
    looked at. An empty table has no rows.
    """
    scratch = Scratch(spark, "sharding")
    held = F.col(f"`{text}`")
    rows = scratch.keep(
        docs.select(
            F.col(f"`{row_id}`").alias("id"), (F.coalesce(F.octet_length(held), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(held.cast("binary")).alias("crc"), F.coalesce(F.sha2(held, 256), F.lit("")).alias("key"),
        ),
        "rows",
    )
    groups = scratch.keep(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    sizes = scratch.keep(groups.groupBy("size").agg(F.count("*").alias("n")), "sizes")
    total, largest = sizes.agg(F.sum(F.col("size") * F.col("n")), F.max("size")).first()
    if capacity is None:
        least = max(-(-(total or 0) // n_shards), largest or 1)
        tried = sorted({least + int(least * share) for share in SLACK} | {2 * least + (largest or 0)})
    else:
        tried = [capacity]
    runs = scratch.keep(pack(sizes, tried), "runs")
    if capacity is None:
        needed = runs.groupBy("capacity").agg((F.max("shard") + 1).alias("n")).where(F.col("n") <= n_shards)
        capacity = needed.agg(F.min("capacity")).first()[0]
    chosen = runs.where(F.col("capacity") == F.lit(capacity).cast("long")).drop("capacity")
    # a size has at most one run per shard: bounded, and joined by size
    ends = chosen.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("runs"))
    placed = numbered(scratch, groups, "groups", ["size"], ["key"])
    met = skew_join(placed, ends, "size", "left", ["place"], hot_keys(placed, "size"))
    last = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("place")), -1)
    assigned = scratch.keep(met.select("key", last["shard"].cast("int").alias("shard")), "assigned")
    sharded = scratch.keep(
        skew_join(rows, assigned, "key", "inner", ["id"], hot_keys(rows, "key")).select("id", "size", "crc", "key", "shard"), "sharded"
    )
    out = numbered(scratch, sharded, "slots", ["shard"], ["key", "id"])
    return out.select(
        F.col("id").alias(row_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
