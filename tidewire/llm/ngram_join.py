"""Near copies by an exact Jaccard self-join of word shingles.

The order is rare first. Two fixed tables of 2^20 counters, summed over all documents,
say how often the hash buckets of words and of shingles occur. Shingles of a bucket far
above the mean come last; the others are ranked by the product of their words' counts,
then by hash. Any order that all documents share gives whole results; a good one keeps
common shingles out of the prefixes. Two sets that meet the threshold share a shingle
of their prefixes.

Equal texts are one node, so copies never meet. Of a prefix only shingles that another
node has as well count further. Among the nodes of a shingle each is first held against
one hub, the node with the fewest shingles of its own before it. Once those links are
merged, only nodes still in different components are paired, where they first share a
shingle, if lengths and places allow it. Before texts move, counts by hash range bound
the overlap (a suffix filter with fixed cuts). A pair is verified once, on whole texts. A group of near copies so costs
pairs in proportion to its size, and every link between components is still found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import grams
from tidewire.llm.graph import components
from tidewire.operators.skew import sized
from tidewire.session import Scratch, batches_of

BUCKET_BITS = 20
ACROSS = 32
#: Shingles per hash range, on average; ranges are a power of two up to 2^MOST_RANGE_BITS.
RANGE_SIZE, MOST_RANGE_BITS = 4, 12
#: Texts held against one pivot in one sorted run; more go to further runs.
LEAVES = 256
#: Bytes of rows that go to Python at a time, however long the texts.
BATCH_BYTES = 4 << 20
_FULL = np.iinfo(np.uint8).max


def _counters(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and words by hash bucket: fixed tables per task, summed by Spark."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, dtype=np.int64)
        for batch in batches:
            for _, data, ends in grams.slices(batch.column(0)):
                h, _ = grams.words(data, ends, grams.SPACE_WORD)
                np.add.at(total, grams.bucket(h, size) + size, 1)
                for found, _ in grams.shingles(data, ends, grams.SPACE_WORD, n):
                    np.add.at(total, grams.bucket(found, size), 1)
        rows = total.reshape(-1, ACROSS)
        used = np.flatnonzero(rows.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 4096)):
            columns = [pa.array(some)] + [pa.array(rows[some, k]) for k in range(ACROSS)]
            yield pa.RecordBatch.from_arrays(columns, ["row", *names])

    names = [f"c{k}" for k in range(ACROSS)]
    schema = "row long, " + ", ".join(f"{c} long" for c in names)
    summed = docs.select("text").mapInArrow(count, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    table = np.zeros((2 * size // ACROSS, ACROSS), dtype=np.int64)
    got = summed.toArrow()
    if len(got):
        table[got["row"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in names])
    return table.ravel()[:size], table.ravel()[size:]


def _ranks(shingles: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of shingle buckets, 0 for all that chance explains; weights of words."""
    mean = shingles.mean()
    chance = mean + 8 * np.sqrt(mean) + 8
    kind = np.ceil(4 * np.log2(np.maximum(shingles / chance, 1))).astype(np.uint8)
    return kind, (64 * np.log2(words + 1)).astype(np.int32)


def _prefixes(docs: DataFrame, ranks, n: int, percent: int) -> DataFrame:
    """Per row its set's size; per node and task also its prefix and counts by range."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (kinds, weight), seen = ranks.value, set()
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            sizes, tokens, counts = [], [], []
            sets = grams.shingle_sets(batch.column("text"), n, weight=weight)
            for node, (found, weights) in zip(nodes, sets, strict=True):
                m = len(found)
                sizes.append(m)
                if not m or node in seen:
                    tokens.append(None)
                    counts.append(None)
                    continue
                seen.add(node)
                kind = kinds[grams.bucket(found, len(kinds))].astype(np.int64)
                order = np.argsort((kind << 32) + weights, kind="stable")  # found is sorted by hash
                tokens.append(found[order[: m - -(-percent * m // 100) + 1]].view(np.int64))
                counts.append(_by_range(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("node"), pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.list_(pa.int64())), pa.array(counts, pa.binary()),
                ],
                ["_id", "node", "size", "tokens", "counts"],
            )

    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, node long, size long, tokens array<long>, counts binary"
    return docs.select("_id", "node", "text").mapInArrow(prefixes, schema)


def _by_range(found: np.ndarray) -> bytes:
    """How many shingles fall into each range of their last bits, a byte each."""
    size = 1 << min(MOST_RANGE_BITS, (len(found) // RANGE_SIZE).bit_length())
    spread = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(spread, _FULL).astype(np.uint8).tobytes()


def _most_shared(a: bytes, b: bytes) -> int | None:
    """The overlap that two counts by range allow; None if a count is not exact.

    The ranges of the longer one are halves, quarters and so on of the other's.
    """
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if x.max() == _FULL or y.max() == _FULL:
        return None
    size = min(len(x), len(y))
    x, y = (v.reshape(-1, size).sum(axis=0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum())


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Shared shingles that sets of these sizes need: I >= percent (a + b) / (100 + percent)."""
    return F.ceil(percent * (a + b) / (100 + percent))


def _alike(percent: int, a: str = "a", b: str = "b") -> Column:
    """Length filter."""
    size = (F.col(f"{a}.size"), F.col(f"{b}.size"))
    return 100 * F.least(*size) >= percent * F.greatest(*size)


def _fits(percent: int, a: str = "a", b: str = "b") -> Column:
    """Length filter, and what is left of both sets where they first share a shingle.

    At the first shared shingle nothing before it matches, so the overlap is at most it
    and what is left of the smaller rest. If both nodes have the same shared shingle
    just before, this is not the first one, and the pair is met there.
    """
    size, pos, prev = ((F.col(f"{a}.{f}"), F.col(f"{b}.{f}")) for f in ("size", "pos", "prev"))
    most = F.least(size[0] - pos[0], size[1] - pos[1])
    later = F.coalesce(prev[0] == prev[1], F.lit(False))
    return _alike(percent, a, b) & (most >= _needed(*size, percent)) & ~later


def _overlap_bound(pairs: DataFrame, spread: DataFrame, percent: int) -> DataFrame:
    """Pairs whose counts by hash range can still add up to the overlap they need."""
    for side in ("a", "b"):
        own = [F.col(c).alias(f"{o}{side}") for c, o in (("node", ""), ("counts", "c"), ("size", "s"))]
        pairs = pairs.join(spread.select(*own), side)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ca", "cb", "sa", "sb")]
            ok = []
            for a, b, size_a, size_b in zip(*columns, strict=True):
                most = _most_shared(a, b)
                ok.append(most is None or (100 + percent) * most >= percent * (size_a + size_b))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(bound, "a long, b long")


def _verified(scratch: Scratch, docs: DataFrame, pairs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that meet the threshold, each held against whole texts once.

    Rows of one pivot ``a`` are sorted behind its text, at most LEAVES to a run.
    """
    pairs = scratch.keep(pairs, f"{name}-pairs")
    used = sized(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    texts = scratch.keep(
        docs.join(used, "node", "left_semi").dropDuplicates(["node"]).select("node", "text"), f"{name}-texts"
    )
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).alias("runs"))
    dealt = pairs.join(runs, "a").withColumn("run", F.pmod(F.xxhash64("b"), F.col("runs")))
    leaves = dealt.join(texts, dealt["b"] == texts["node"]).select("a", "run", "node", "text")
    heads = dealt.select("a", "run").distinct().join(texts, F.col("a") == F.col("node"))
    rows = leaves.withColumn("leaf", F.lit(True)).unionByName(
        heads.select("a", "run", "node", "text", F.lit(False).alias("leaf"))
    )
    sorted_rows = rows.repartition("a", "run").sortWithinPartitions("a", "run", "leaf")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            a, node, leaf = (batch.column(c).to_pylist() for c in ("a", "node", "leaf"))
            kept: list[int] = []
            for i, (found, _) in enumerate(grams.shingle_sets(batch.column("text"), n)):
                if not leaf[i]:
                    pivot = found
                    continue
                shared = np.intersect1d(pivot, found, assume_unique=True).size
                if 100 * shared >= percent * (len(pivot) + len(found) - shared):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for i in kept], pa.int64()) for x in (a, node)], ["a", "b"]
            )

    links = scratch.keep(sorted_rows.select("a", "node", "leaf", "text").mapInArrow(verify, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-texts")
    return links


def groups(
    spark: SparkSession,
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, node, size, component, component_id) of every row, linked at ``percent`` of Jaccard.

    ``node`` is the hash of the text and ``component`` the least node of the group.
    Words lie between ASCII spaces, A-Z lower-cased. A text without words, or null, has
    size 0 and is linked with nothing, its like included. Equal texts are linked. A
    component is named by its least id; a null id counts as none, and a group of null
    ids only has a null component. Copies of a row are members like others.
    """
    with batches_of(spark, BATCH_BYTES):
        return _groups(spark, docs, n, percent, row_id, text)


def _groups(spark: SparkSession, docs: DataFrame, n: int, percent: int, row_id: str, text: str) -> DataFrame:
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(
        F.col(f"`{row_id}`").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("node"),
        F.col(f"`{text}`").alias("text"),
    )
    ranks = spark.sparkContext.broadcast(_ranks(*_counters(docs, n)))
    sets = scratch.keep(_prefixes(docs, ranks, n, percent), "sets")
    spread = sets.where(F.col("counts").isNotNull()).select("node", "counts", "size").dropDuplicates(["node"])

    # size and place as one number: the widest shuffle carries three columns
    at = (F.shiftleft("size", 32) + F.col("pos")).alias("at")
    size, pos = F.shiftright("at", 32).alias("size"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")
    posts = sets.where(F.col("tokens").isNotNull()).select("node", "size", F.posexplode("tokens").alias("pos", "token"))
    one = Window.partitionBy("token")
    shared = (
        posts.select("token", "node", at)
        .withColumns({"low": F.min("node").over(one), "high": F.max("node").over(one)})
        .where("low < high").select("token", "node", size, pos).distinct()
    )
    shared = scratch.keep(shared, "shared")
    inside = Window.partitionBy("node").orderBy("pos", "token")
    own = (F.col("pos") + 1 - F.row_number().over(inside)).alias("own")
    ranked = scratch.keep(shared.select("*", F.lag("token").over(inside).alias("prev"), own), "ranked")
    node = F.struct("node", "size", "pos", "prev")
    hubs = ranked.groupBy("token").agg(F.min(F.struct("own", node.alias("a"))).alias("hub"))
    star = ranked.select("token", node.alias("b")).join(hubs.select("token", "hub.a"), "token")
    star = star.where((F.col("a.node") != F.col("b.node")) & _alike(percent))
    star = star.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    first = _verified(scratch, docs, _overlap_bound(star, spread, percent), n, percent, "star")
    merged = scratch.keep(components(scratch, first, "merge"), "merged")

    label = F.coalesce("label", "node").alias("label")
    named = ranked.join(merged, "node", "left").select("token", "node", "size", "pos", "prev", label)
    named = scratch.keep(named, "named")
    mixed = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    left = named.join(mixed.select("token"), "token", "left_semi")
    a = left.select("token", F.struct("node", "size", "pos", "prev", "label").alias("a"))
    b = left.select("token", F.struct("node", "size", "pos", "prev", "label").alias("b"))
    across = a.join(b, "token").where((F.col("a.label") < F.col("b.label")) & _fits(percent))
    across = across.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    second = _verified(scratch, docs, _overlap_bound(across, spread, percent), n, percent, "rest")
    labels = scratch.keep(components(scratch, first.union(second), "joined"), "labels")

    members = sets.select("_id", "node", "size").join(labels, "node", "left")
    members = scratch.keep(members.select("_id", "node", "size", label), "members")
    # written, so that the join deals labels anew and may split a large group
    least = members.where("size > 0").groupBy("label").agg(F.min("_id").alias("component_id"))
    least = scratch.keep(least, "least")
    found = members.join(least, "label", "left").select(
        F.col("_id").alias(row_id), "node", "size", F.col("label").alias("component"),
        F.when(F.col("size") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    scratch.drop("sets", "shared", "ranked", "named", "merged", "labels", "star-pairs", "rest-pairs", "star-links", "rest-links")
    return found


def keep_one(
    spark: SparkSession,
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row of each group, with the columns it came with.

    The least id stays, null last, then the least text hash; of equal rows one stays.
    Rows without words stay, as they are in no group. Only the keys of rows that go
    are joined to the texts: broadcast if they are few, else by a shuffle.
    """
    scratch = Scratch(spark, "ngram-keep")
    key = F.when(F.col(f"`{row_id}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{row_id}`").cast("string")))
    found = groups(spark, docs, n, percent, row_id, text)
    rows = scratch.keep(
        found.where("size > 0").select(F.col(f"`{row_id}`").alias("_id"), key.alias("_key"), "node", "component"), "rows"
    )
    rank = F.struct(F.col("_id").isNull(), "_id", "node", "_key")
    first = rows.groupBy("component").agg(F.min(rank).alias("first"))
    kept = first.select(F.col("first._key").alias("_key"), F.col("first.node").alias("node"))
    gone = sized(rows.select("_key", "node").distinct().join(kept, ["_key", "node"], "left_anti"))
    again = sized(
        rows.groupBy("_key", "node").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
        .join(kept, ["_key", "node"], "left_semi")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, key.alias("_key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("node"))
    left = keyed.join(gone, ["_key", "node"], "left_anti")
    single = left.join(again, ["_key", "node"], "left_anti")
    repeated = left.join(again, ["_key", "node"], "left_semi").dropDuplicates(["_key", "node"])
    return single.unionByName(repeated).select("_row.*")
