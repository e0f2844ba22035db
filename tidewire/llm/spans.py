"""Substring dedup by sliding spans of sentences.

The shortest run of several sentences with enough words that begins with a sentence, and
the shortest that ends with it, are hashed, so that the runs inside a passage cover all of
it wherever it stands; a text too short for a run is one as a whole. Runs are met
globally, and the sentences under every run but the first of its kind go. The first is
that of the least id, then of the earliest place. A sentence too long to be matched whole
is cut behind the word of least hash in every window of words, so that copies of a
passage are cut alike wherever they stand.

A hash keeps its least place by a partial aggregate, and all its places meet that one
row in a join whose hot side Spark may split: no group of equal runs is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.words import without
from tidewire.session import Scratch

#: A run has at least so many sentences and so many words.
SENTENCES, WORDS = 2, 12
#: Longer sentences are cut at least once in every WINDOW words. Copies of 5 * WINDOW words
#: share all cuts but those in the WINDOW - 1 words at either end, hence more than WORDS
#: words in two pieces or more.
LONG, WINDOW = 24, 10
#: Places of removed runs that are broadcast to the texts; more are joined by shuffle.
BROADCAST_PLACES = 1_000_000
#: Words whose hashes a worker keeps.
REMEMBERED_WORDS = 1 << 16
RESULT = ["n_sentences", "n_removed"]
#: The second way starts where white space does, so that a long run of it is read once.
_END = re.compile(r"(?<=[.!?…。])\s+|(?<!\s)\s*\n\s*")
_WORD = re.compile(r"\S+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of sentences with a word, in order."""
    out, at = [], 0
    for stop in [*(m.span() for m in _END.finditer(text)), (len(text), len(text))]:
        part = text[at : stop[0]]
        words = part.lower().split()
        if len(words) > LONG:
            out += _pieces(text, at, stop[0])
        elif words:
            out.append((at, stop[0], words))
        at = stop[1]
    return out


def _pieces(text: str, start: int, stop: int) -> Iterator[tuple[int, int, list[str]]]:
    places = [m.span() for m in _WORD.finditer(text, start, stop)]
    words = [text[a:b].lower() for a, b in places]
    at = 0
    for cut in [*_cuts(words), len(words) - 1]:
        if cut >= at:
            yield places[at][0], places[cut][1] if cut + 1 < len(words) else stop, words[at : cut + 1]
            at = cut + 1


def wordings(text: str) -> list[list[str]]:
    """The words of ``sentences`` alone, for texts whose sentences stay where they are."""
    out, at = [], 0
    for stop in [*(m.span() for m in _END.finditer(text)), (len(text), len(text))]:
        words = text[at : stop[0]].lower().split()
        if len(words) > LONG:
            last = 0
            for cut in [*_cuts(words), len(words) - 1]:
                if cut >= last:
                    out.append(words[last : cut + 1])
                    last = cut + 1
        elif words:
            out.append(words)
        at = stop[1]
    return out


_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    """The word's hash; so many words are remembered by a worker."""
    found = _hashes.get(word)
    if found is None:
        if len(_hashes) >= REMEMBERED_WORDS:
            _hashes.clear()
        found = _hashes[word] = xxhash.xxh3_64_intdigest(word)
    return found


def _cuts(words: list[str]) -> list[int]:
    """The words with the least hash of a window, the last one of equals."""
    hashes = [_hash(w) for w in words]
    out, least = [], 0
    for end, h in enumerate(hashes):
        if least <= end - WINDOW:
            least = min(range(end, end - WINDOW, -1), key=hashes.__getitem__)
        elif h <= hashes[least]:
            least = end
        if end >= WINDOW - 1 and (not out or out[-1] != least):
            out.append(least)
    return out


def runs(found: list[tuple[int, int, list[str]]]) -> list[tuple[int, int, int]]:
    """The runs of ``sentences``."""
    return runs_of([words for _, _, words in found])


def runs_of(found: list[list[str]]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentence behind the last) of the shortest run from each
    sentence and of the shortest up to each, in order; or of all if that is too short."""
    counts = [len(w) for w in found]
    joined = [" ".join(w) for w in found]
    places: set[tuple[int, int]] = set()
    end = held = 0
    for i in range(len(found)):
        while end < len(found) and (held < WORDS or end - i < SENTENCES):
            held += counts[end]
            end += 1
        if held < WORDS or end - i < SENTENCES:
            break
        places.add((i, end))
        held -= counts[i]
    i = held = 0
    for end in range(1, len(found) + 1):
        held += counts[end - 1]
        while held - counts[i] >= WORDS and end - i > SENTENCES:
            held -= counts[i]
            i += 1
        if held >= WORDS and end - i >= SENTENCES:
            places.add((i, end))
    if found and not places:
        places.add((0, len(found)))
    return [(xxhash.xxh3_64_intdigest("\n".join(joined[i:end])) - (1 << 63), i, end) for i, end in sorted(places)]


def strip(text: str, places: list[int]) -> tuple[str, int, int]:
    """The text without the sentences under the runs of these numbers."""
    if not places:
        return text, len(wordings(text)), 0
    found = sentences(text)
    gone: set[int] = set()
    of_text = runs(found)
    for i in places:
        gone.update(range(*of_text[i][1:]))
    if not gone:
        return text, len(found), 0
    # a sentence goes with the space behind it
    out, at = [], 0
    for i, (start, _, _) in enumerate(found):
        if i in gone:
            out.append(text[at:start])
            at = found[i + 1][0] if i + 1 < len(found) else len(text)
    return "".join([*out, text[at:]]), len(found), len(gone)


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [[h for h, _, _ in runs_of(wordings(t or ""))] for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_node"), pa.array(hashes, pa.list_(pa.int64()))], ["_id", "_node", "runs"]
        )


def dedup(spark: SparkSession, docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row, its text without repeated runs, ``n_sentences`` and ``n_removed``.

    Null ids come last. Rows of equal id and text are one document given more than once:
    they count once and get equal results, the whole text if it is the first of its
    kind. A null text stays null with no sentences; a text of which all goes is empty.
    Input columns named as a result give way to it, all others pass unchanged.
    """
    scratch = Scratch(spark, "spans")
    node = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(F.col(f"`{row_id}`").alias("_id"), node.alias("_node"), F.col(f"`{text}`").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    posts = rows.mapInArrow(_posts, f"_id {id_type}, _node long, runs array<long>")
    posts = scratch.keep(posts.where(F.size("runs") > 0), "runs")
    places = posts.select("_id", "_node", F.posexplode("runs").alias("place", "run"))
    order = F.struct(F.col("_id").isNull(), "_id", "_node", "place")
    first = places.groupBy("run").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last")
    first = scratch.keep(first.select("run", "first"), "first")
    later = places.join(first, "run").where(order != F.col("first"))
    removed = scratch.keep(
        later.groupBy("_id", "_node").agg(F.array_sort(F.collect_set("place")).alias("_places")), "removed"
    )
    total = removed.agg(F.sum(F.size("_places") + 4)).first()[0] or 0
    scratch.drop("runs", "first")
    kept = without(docs, RESULT)
    names = kept.columns
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in names], F.col(f"`{row_id}`").alias("_a"), node.alias("_b")
    )
    found = F.broadcast(removed) if total <= BROADCAST_PLACES else removed
    joined = keyed.join(found, (F.col("_b") == F.col("_node")) & F.col("_a").eqNullSafe(F.col("_id")), "left")
    result = T.StructType([*kept.schema.fields]).add("n_sentences", "long").add("n_removed", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for value, at in zip(batch.column(text).to_pylist(), batch.column("_places").to_pylist(), strict=True):
                new, n, k = (None, 0, 0) if value is None else strip(value, at or [])
                texts.append(new)
                counts.append(n)
                gone.append(k)
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            columns += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in result.fields])

    return joined.select(*names, "_places").mapInArrow(cut, result)
