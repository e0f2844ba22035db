"""Texts to vectors: the encoder protocol and its use on whole tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.ids import content_key
from tidewire.functions.text import truncate
from tidewire.functions.vectors import projection_matrix
from tidewire.operators.skew import hot_keys, skew_join

_VECTOR = T.ArrayType(T.FloatType())

# Context limits, in characters, of encoders that have one.
QUERY_CHARS = 2000
HOURLY_CHARS = 4000

#: Characters of texts that are handed to an encoder at once, a longer text alone; and words
#: that the hashing encoder remembers.
ENCODED_CHARS = 1 << 20
REMEMBERED_WORDS = 1 << 16


#: Lower-cased letters and digits of ASCII, blanks for all else.
_ASCII_WORDS = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))


class _Slots(dict):
    """The slot of a word, past the width if its sign is minus; what was asked for is kept."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode()).hexdigest()
        slot = int(digest[:8], 16) % self.width + self.width * (int(digest[8], 16) % 2)
        if len(self) < REMEMBERED_WORDS:
            self[word] = slot
        return slot


class Encoder(Protocol):
    """Turns a batch of texts into a float32 matrix of fixed width.

    ``load`` runs once per Python worker. ``max_chars`` is the context limit of
    the model, or None when it reads whole texts. Encoders of one ``fingerprint`` give
    equal vectors.
    """

    width: int
    max_chars: int | None
    fingerprint: str

    def load(self): ...


@dataclass(frozen=True)
class HashingEncoder:
    """Signed feature hashing of words; needs no model and no network.

    A word goes to the slot given by the first 32 bits of its MD5 modulo the
    width, with the sign of the next hex digit. It reads whole texts.
    """

    width: int = 64
    max_chars: int | None = None

    @property
    def fingerprint(self) -> str:
        return f"hashing:{self.width}:{self.max_chars}"

    def load(self):
        words, slots, width = re.compile(r"[^\W_]+"), _Slots(self.width), self.width

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for row, text in enumerate(texts):
                # the words of an ASCII text are told by a table, at once
                found = text.translate(_ASCII_WORDS).split() if text.isascii() else words.findall(text.lower())
                if found:
                    hits = np.bincount(np.fromiter(map(slots.__getitem__, found), np.int64, len(found)), minlength=2 * width)
                    out[row] = hits[:width] - hits[width:]
                if len(slots) >= REMEMBERED_WORDS:
                    slots.clear()
            length = np.sqrt((out * out).sum(axis=1))
            return (out / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)

        return encode


@dataclass(frozen=True)
class ProjectedEncoder:
    """An encoder of another width, brought to ``width`` by a projection.

    The matrix follows from the seed, unless one is given that a table has kept.
    """

    base: Encoder
    width: int
    seed: int = 0
    kept: tuple[tuple[float, ...], ...] | None = None

    @property
    def max_chars(self) -> int | None:
        return self.base.max_chars

    @property
    def matrix(self) -> np.ndarray:
        if self.kept is not None:
            return np.array(self.kept, dtype=np.float32)
        return projection_matrix(self.base.width, self.width, self.seed)

    @property
    def fingerprint(self) -> str:
        digest = hashlib.sha256(np.ascontiguousarray(self.matrix, dtype=np.float32).tobytes()).hexdigest()
        return f"{fingerprint(self.base)}>projected:{self.width}:{self.seed}:{digest[:16]}"

    def load(self):
        encode = self.base.load()
        matrix = self.matrix

        def project(texts: list[str]) -> np.ndarray:
            out = encode(texts).astype(np.float64) @ matrix.astype(np.float64)
            length = np.sqrt((out * out).sum(axis=1))
            return (out / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)

        return project


def fingerprint(encoder: Encoder) -> str:
    """The encoder's own, or its class and width."""
    return getattr(encoder, "fingerprint", None) or f"{type(encoder).__name__}:{encoder.width}"


def isolated(encode: Callable[[list[str]], np.ndarray], texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the texts, and which of them there are.

    A batch on which the encoder raises is halved until the text that fails is alone:
    it costs no other text, and about twice the logarithm of the batch in calls.
    """
    out, made = np.zeros((len(texts), width), dtype=np.float32), np.ones(len(texts), dtype=bool)
    todo = [(0, len(texts))] if texts else []
    while todo:
        start, stop = todo.pop()
        try:
            found = encode(texts[start:stop])
        except Exception:  # whatever a model raises on a text
            if stop - start == 1:
                made[start] = False
            else:
                middle = (start + stop) // 2
                todo += [(middle, stop), (start, middle)]
            continue
        out[start:stop] = found
    return out, made


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, some ENCODED_CHARS at a time: a batch of long ones is not unpacked whole."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    portion = np.cumsum(sizes, dtype=np.int64) // ENCODED_CHARS
    cuts = np.flatnonzero(np.diff(portion)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        yield texts.slice(start, stop - start)


def _encoded(texts: pa.Array, encode: Callable[[list[str]], np.ndarray], width: int) -> pa.Array:
    """A vector per text; null stays null, and a text that cannot be encoded gets null."""
    present = texts.is_valid().to_numpy(zero_copy_only=False).copy()
    parts = [isolated(encode, part.drop_null().to_pylist(), width) for part in _portions(texts)]
    values, made = np.concatenate([v for v, _ in parts]), np.concatenate([m for _, m in parts])
    present[present] = made
    ends = np.cumsum(np.r_[0, present * width])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(values[made].ravel()), mask=pa.array(~present)
    )


def encode_column(encoder: Encoder, max_chars: int | None = None):
    """A function from a text column to a vector column; null stays null."""
    limit = max_chars or encoder.max_chars

    @F.arrow_udf(_VECTOR)
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder.load()
        for texts in batches:
            yield _encoded(texts, encode, encoder.width)

    def apply(text: Column) -> Column:
        return vectors(truncate(text, limit) if limit else text)

    return apply


def embed(
    df: DataFrame, texts: dict[str, Column], encoder: Encoder, max_chars: int | None = None, seen: Accumulator | None = None
) -> DataFrame:
    """Add one vector column per named text; all texts of a row cross to Python once.

    ``seen`` counts the rows of tasks that are done.
    """
    limit = max_chars or encoder.max_chars
    names = list(texts)

    @F.arrow_udf(T.StructType([T.StructField(n, _VECTOR) for n in names]))
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder.load()
        for rows in batches:
            columns = [_encoded(rows.field(i), encode, encoder.width) for i in range(len(names))]
            if seen is not None:
                seen.add(len(rows))
            yield pa.StructArray.from_arrays(columns, names)

    told = F.struct(*[(truncate(c, limit) if limit else c).alias(n) for n, c in texts.items()])
    kept = [c for c in df.columns if c not in texts]
    # Taken for deterministic, it would run again below every filter on the vectors.
    once = vectors.asNondeterministic()
    return df.withColumn("_vectors", once(told)).select(*kept, "_vectors.*")


def embedding_cache(
    df: DataFrame, text: str, encoder: Encoder, cache: DataFrame | None = None
) -> DataFrame:
    """Vectors of the distinct texts not yet in the cache, keyed by content.

    Copies are combined before the shuffle, so a text on a third of all rows is
    encoded once, and once only it meets the cache.
    """
    keyed = df.where(F.col(text).isNotNull()).select(
        content_key(F.col(text)).alias("content_key"), F.col(text).alias("_text")
    )
    fresh = keyed.dropDuplicates(["content_key"])
    if cache is not None:
        fresh = fresh.join(cache.select("content_key"), "content_key", "left_anti")
    return fresh.select("content_key", encode_column(encoder)(F.col("_text")).alias("vector"))


def embed_with_reuse(
    df: DataFrame, text: str, out: str, encoder: Encoder, cache: DataFrame | None = None
) -> DataFrame:
    """Encode each distinct text once, and none that the cache already holds.

    ``cache`` has the columns ``content_key`` and ``vector``. The copies of a
    text meet its vector in a salted join.
    """
    made = embedding_cache(df, text, encoder, cache)
    known = made if cache is None else made.unionByName(cache.select("content_key", "vector"))
    keyed = df.withColumn("content_key", content_key(F.col(text))).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    joined = skew_join(
        keyed, known, "content_key", "left", ["_row"], hot_keys(keyed, "content_key")
    )
    return joined.withColumnRenamed("vector", out).drop("_row")
