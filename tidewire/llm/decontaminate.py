"""Benchmark decontamination with an Aho-Corasick automaton over words.

Every window of an item's words is a pattern. A word of the benchmark is one symbol of
the automaton's alphabet and all other words share one, so a text is scanned once, a
step per word, and a match ends at the number of a word. Hits map back to offsets of
the original text. The corpus is one narrow pass: no shuffle, and a lost executor
costs its own splits.

Only the text crosses to Python, and only what was found comes back; other columns stay
where they are.

The benchmark is broadcast. Its size is taken first: up to ``most_bytes`` of text go
into one automaton. A larger benchmark is dealt by hash into as many as needed, and the
corpus is scanned once for each, a job at a time, so that a worker never holds more than
one: the hits of each distinct text that has some are written, and joined back at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.words import without
from tidewire.operators.skew import hot_keys, skew_join
from tidewire.session import Scratch

WINDOW = 10
#: Text in one automaton: some 200,000 windows of ten words, about 100 MB in a worker.
MOST_BYTES = 1 << 20
_KEEP = {*range(48, 58), *range(97, 123), *range(128, 256)}
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FIRST_SYMBOL = 0x10000  # past the surrogates; a million symbols follow
RESULT = ["n_words", "n_hit", "items", "spans", "contaminated"]


def split(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and all past ASCII; A-Z lower-cased."""
    return (text or "").encode().translate(_CLEAN).split()


class Windows:
    """The automaton of some items: (id, text) pairs; an id of None names nothing."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for name, text in items:
            word = [self.symbols.setdefault(w, chr(_FIRST_SYMBOL + len(self.symbols))) for w in split(text)]
            for i in range(max(1, len(word) - window + 1) if word else 0):
                owners.setdefault("".join(word[i : i + window]), set()).update([name] if name is not None else [])
        self.automaton = ahocorasick.Automaton()
        for pattern, names in owners.items():
            self.automaton.add_word(pattern, (len(pattern), names))
        self.automaton.make_automaton()
        self.some = bool(owners)

    def scan(self, word: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, merged and in order, and the items found."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.some:
            return spans, items
        line = "".join(map(self.symbols.get, word, repeat("\x01")))
        for last, (length, names) in self.automaton.iter(line):
            items |= names
            start, stop = last + 1 - length, last + 1
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, stop))
        return spans, items


def _union(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


_SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
_FOUND = (
    T.StructType().add("n_words", "long").add("hits", _SPANS).add("n_hit", "long")
    .add("items", T.ArrayType(T.StringType())).add("spans", _SPANS)
)


def _scanner(share):
    """A function of (text, hits, items): what is known, and what these items add to it.

    ``hits`` are stretches of words, ``spans`` the same as code points.
    """

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = Windows(share.value)
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for rows in batches:
            n_words, hits, items, spans = [], [], [], []
            for text, known, owners in zip(*(rows.field(i).to_pylist() for i in range(3)), strict=True):
                word = split(text)
                new, more = windows.scan(word)
                both = _union([*new, *((x["start"], x["end"]) for x in known or ())])
                at = [m.span() for m in _WORD.finditer(text)] if both else []
                n_words.append(len(word))
                hits.append([{"start": a, "end": b} for a, b in both])
                items.append(sorted({*more, *(owners or ())}))
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in both])
            yield pa.StructArray.from_arrays(
                [
                    pa.array(n_words, pa.int64()), pa.array(hits, pairs),
                    pa.array([sum(x["end"] - x["start"] for x in h) for h in hits], pa.int64()),
                    pa.array(items, pa.list_(pa.string())), pa.array(spans, pairs),
                ],
                names=_FOUND.names,
            )

    return found


def _found(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, most_bytes: int
) -> DataFrame:
    """Each row as ``_row``, with ``_found``: what the benchmark's windows hit in its text."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // most_bytes))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    own = F.col("_text")
    hits, named = F.lit(None).cast(_SPANS).alias("hits"), F.lit(None).cast("array<string>").alias("items")

    def scanner(k: int):
        some = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        return _scanner(spark.sparkContext.broadcast([tuple(r) for r in some.collect()]))

    if parts == 1:
        return rows.withColumn("_found", scanner(0)(F.struct(own, hits, named)))
    scratch = Scratch(spark, "decontaminate")
    key = F.coalesce(F.md5(own), F.lit(""))
    passes = []
    for k in range(parts):
        scanned = rows.select(key.alias("_key"), scanner(k)(F.struct(own, hits, named)).alias("found"))
        passes.append(
            scratch.keep(
                scanned.where("found.n_hit > 0").select("_key", "found.hits", "found.items").dropDuplicates(["_key"]), f"part{k}"
            )
        )
    every = reduce(DataFrame.unionByName, passes)
    met = every.groupBy("_key").agg(
        F.flatten(F.collect_list("hits")).alias("_hits"), F.flatten(F.collect_list("items")).alias("_items")
    )
    met = scratch.keep(met, "met")
    keyed = rows.withColumn("_key", key).withColumn("_at", F.monotonically_increasing_id())
    joined = skew_join(keyed, met, "_key", "left", ["_at"], hot_keys(met.join(keyed.select("_key"), "_key").select("_key"), "_key"))
    told = F.struct(own, F.col("_hits").alias("hits"), F.col("_items").alias("items"))
    nothing = _scanner(spark.sparkContext.broadcast([]))
    return joined.select("_row", nothing(told).alias("_found"))


def scan(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Every row with ``n_words``, ``n_hit``, ``items``, ``spans`` and ``contaminated``.

    A window is ten consecutive words of an item; a shorter item is one window, one
    without words is none. ``items`` are the distinct ids whose windows occur, as
    sorted strings; items of a null id hit words, but are not named. ``spans`` are the
    hit stretches as code point offsets of the original text. A null text has no
    words. Repeated items and rows change nothing. Input columns named as a result
    give way to it.
    """
    found = _found(spark, docs, benchmark, text, item_id, item_text, most_bytes)
    kept = [F.col(f"_row.`{c}`") for c in without(docs, RESULT).columns]
    told = [F.col(f"_found.{c}").alias(c) for c in RESULT[:-1]]
    return found.select(*kept, *told, (F.col("_found.n_hit") > 0).alias("contaminated"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows without a benchmark window, with the columns they came with."""
    found = _found(spark, docs, benchmark, text, "item_id", "text", MOST_BYTES)
    return found.where("_found.n_hit = 0").select("_row.*")
