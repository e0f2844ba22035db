"""Scores of texts by a model mixed from hashed contexts, beside smoothed word counts.

One pass counts, over all training texts, their words and the bytes behind every hashed
context; Spark sums both. Context counts become fixed tables of bit odds (their size
does not depend on the corpus), which every task mixes online while it codes a text.

Word counts stay a table. The words so frequent that a bounded number of them can be
are broadcast with their counts; the others of each text are joined to the table. Only
those rarer ones move, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import grams, mixer
from tidewire.session import Scratch

#: Words that may be broadcast with their counts: 16 bytes each.
FREQUENT = 1 << 20
#: Behind every text, counted as a word.
END_WORD = int(grams.mix(np.array([0x656E64], dtype=np.uint64))[0])
RESULT = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
_WORDS = -1


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 16):
        part = slice(at, at + (1 << 16))
        columns = [pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part]), pa.array(counts[part])]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts: words, summed by megabyte, and (context, byte) pairs, once."""
    tables = mixer.counters(np.uint32)
    texts = 0
    for batch in batches:
        texts += batch.num_rows
        for _, data, ends in grams.slices(batch.column(0)):
            words, _ = grams.words(data, ends, grams.SPACE_WORD)
            keys, counts = np.unique(words, return_counts=True)
            yield from _rows(_WORDS, keys.view(np.int64), counts.astype(np.int64))
            mixer.count(data, ends, tables)
    if texts:
        yield from _rows(_WORDS, np.array([END_WORD], np.uint64).view(np.int64), np.array([texts], np.int64))
    for kind, table in enumerate(tables):
        keys = np.flatnonzero(table)
        yield from _rows(kind, keys.astype(np.int64), table[keys].astype(np.int64))


class Model:
    """What every task needs: bit odds, and the frequent words with their counts."""

    def __init__(self, odds: list[np.ndarray], words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.odds, self.words, self.counts = odds, words, counts
        self.total, self.distinct = total, distinct

    def log_share(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def train(scratch: Scratch, texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of these texts (one column), and the table of (key, n) of all words."""
    rows = texts.mapInArrow(_count, "kind int, key long, n long")
    counts = scratch.keep(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where(F.col("kind") == _WORDS).select("key", "n")
    # classes of counts, a few dozen rows: how frequent the broadcast words must be
    half_log = F.floor(2 * F.log2("n")).cast("int")
    classes = words.groupBy(half_log.alias("c")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    cut, left = None, FREQUENT
    for row in sorted(classes, key=lambda r: -r["c"]):
        left -= row["words"]
        if left < 0:
            break
        cut = row["c"]
    total, distinct = sum(r["n"] for r in classes), sum(r["words"] for r in classes)
    frequent = words.where(half_log >= F.lit(cut if cut is not None else 1 << 30)).toArrow()
    keys = frequent["key"].to_numpy().view(np.uint64) if len(frequent) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    many = frequent["n"].to_numpy()[order] if len(frequent) else np.zeros(0, np.int64)
    odds = []
    for kind, table in enumerate(mixer.counters(np.float32)):
        got = counts.where(F.col("kind") == kind).select(F.col("key").cast("int"), F.col("n").cast("float")).toArrow()
        if len(got):
            table[got["key"].to_numpy()] = got["n"].to_numpy()
        odds.append(mixer.odds(table))
    return Model(odds, keys[order], many, total, distinct), words


def _code(shared) -> object:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            scores, sizes, tokens, known, base, rare, times = [], [], [], [], [], [], []
            for _, data, ends in grams.slices(batch.column("_text")):
                scores += mixer.score(data, ends, model.odds).tolist()
                sizes += np.diff(ends).tolist()
                words, first = grams.words(data, ends, grams.SPACE_WORD)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    keys, n = np.unique(np.append(words[a:b], np.uint64(END_WORD)), return_counts=True)
                    at = np.minimum(np.searchsorted(model.words, keys), max(0, len(model.words) - 1))
                    found = model.words[at] == keys if len(model.words) else np.zeros(len(keys), bool)
                    share = model.log_share(model.counts[at[found]])
                    tokens.append(int(b - a) + 1)
                    known.append(int(n[found].sum()))
                    base.append(float((n[found] * share).sum()))
                    rare.append(keys[~found].view(np.int64))
                    times.append(n[~found].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("_key"), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())),
                ],
                ["_id", "_key", "score", "bytes", "n_tokens", "known", "base", "rare", "times"],
            )

    return code


def score(
    spark: SparkSession, docs: DataFrame, training: Column, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, and the columns of RESULT) of every row; ``training`` says what to learn from.

    Words lie between ASCII spaces, A-Z lower-cased, and an end follows each text. ``score``
    is the model's log10 probability of the text's bytes and their end, ``bits_per_byte``
    the same as code length. A null text is empty: one token, its end. Without training
    texts every bit is even. Rows of equal id and text get equal results; each counts.
    """
    scratch = Scratch(spark, "lm")
    model, words = train(scratch, docs.where(training).select(F.col(f"`{text}`").alias("text")))
    # plain arrays, so that workers need no class of this package to read them
    shared = spark.sparkContext.broadcast((model.odds, model.words, model.counts, model.total, model.distinct))
    rows = docs.select(
        F.col(f"`{row_id}`").alias("_id"), F.xxhash64(F.col(f"`{row_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_key"),
        F.col(f"`{text}`").alias("_text"),
    )
    schema = T.StructType([rows.schema["_id"]]).add("_key", "long")
    schema = (
        schema.add("score", "double").add("bytes", "long").add("n_tokens", "long").add("known", "long")
        .add("base", "double").add("rare", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.IntegerType()))
    )
    coded = scratch.keep(rows.mapInArrow(_code(shared), schema), "coded")
    pairs = (
        coded.where(F.size("rare") > 0).select("_key", "rare", "times").dropDuplicates(["_key"])
        .select("_key", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select("_key", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    )
    whole = F.lit(model.total + 0.1 * (model.distinct + 1))
    n = F.coalesce("n", F.lit(0))
    joined = pairs.join(words, "key", "left")
    rest = joined.groupBy("_key").agg(
        F.sum(F.col("times") * F.log10((n + 0.1) / whole)).alias("rest"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    bits = -F.col("score") * float(np.log2(10)) / (F.col("bytes") + 1)
    return coded.join(scratch.keep(rest, "rest"), "_key", "left").select(
        F.col("_id").alias(row_id), "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score", bits.alias("bits_per_byte"),
    )
