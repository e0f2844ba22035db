"""Language by compression: the dictionary that makes a text smallest names it.

Per language a raw-content dictionary is cut from a bounded sample of its training
texts. A text's distinct words, letters only and in order, are compressed piece by piece
behind each dictionary: whole texts count, since every piece meets a fresh dictionary,
and words that a text repeats cannot drown the others. The sample is dealt by hash, its
bounds are parameters, and all else is one narrow pass over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.words import without

#: Bytes of one dictionary, and bytes taken of one training text for it.
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 512
#: Training texts asked for per language; some more or less come, as hashes fall.
SAMPLE_TEXTS = 400
#: Bytes of text behind one use of a dictionary.
PIECE_BYTES = 512
LEVEL = 6
#: Share of the smallest size by which the next must be larger.
MARGIN = 0.02
RESULT = ["lang_pred", "score", "rejected"]
_OTHER = re.compile(r"[\W\d_]+")


def sample(labelled: DataFrame, lang: str = "lang", text: str = "text", row_id: str = "doc_id") -> list[tuple[str, bytes]]:
    """(language, sample text) rows, some SAMPLE_TEXTS per language, chosen by hash.

    One count per language sets the share of the hash space that is drawn, so what
    reaches the driver follows the number of languages, not of documents.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = usable.select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).alias("text"),
        F.xxhash64(F.lit("language"), F.col(row_id), F.octet_length(text)).alias("h"),
    )
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = rows.join(F.broadcast(counts), "lang").where(
        F.pmod("h", F.lit(1 << 30)) < F.ceil(F.lit(float(SAMPLE_TEXTS << 30)) / F.col("n"))
    )
    # the middle of a text: beginnings are more alike
    at = F.greatest(F.lit(1), F.floor(F.length("text") / 2) - SAMPLE_BYTES // 2).cast("int")
    got = drawn.orderBy("lang", "h").select("lang", F.substring("text", at, F.lit(SAMPLE_BYTES)).alias("part")).collect()
    return [(r.lang, r.part.encode()) for r in got]


def letters(text: str) -> list[str]:
    """Lower-cased runs of letters, in order."""
    return _OTHER.sub(" ", text.lower()).split()


def dictionaries(rows: list[tuple[str, bytes]]) -> dict[str, bytes]:
    """One dictionary per language, cut to equal length so that none has an advantage."""
    whole: dict[str, bytes] = {}
    for name, part in rows:
        if len(whole.get(name, b"")) < DICTIONARY_BYTES:
            whole[name] = whole.get(name, b"") + " ".join(letters(part.decode())).encode() + b" "
    return {name: data[:DICTIONARY_BYTES] for name, data in sorted(whole.items())}


class Compressors:
    """Sizes of a text behind each dictionary; equal sizes go to the first name."""

    def __init__(self, known: dict[str, bytes]):
        self.names = sorted(known)
        self.tools = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(known[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.tools.append(
                zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False)
            )

    def sizes(self, word: list[str]) -> list[int]:
        data = " ".join(dict.fromkeys(word)).encode()
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)] or [b""]
        return [sum(len(t.compress(p)) for p in pieces) for t in self.tools]

    def name(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether the margin is too narrow to trust it)."""
        if not self.names or not any(map(str.isalpha, text or "")):
            return "und", 0.0, True
        word = letters(text)
        found = self.sizes(word)
        best = min(range(len(found)), key=found.__getitem__)
        if len(found) == 1:
            return self.names[best], 1.0, False
        next_best = min(v for i, v in enumerate(found) if i != best)
        margin = (next_best - found[best]) / found[best]
        return self.names[best], margin / (margin + MARGIN), margin < MARGIN


def identify(spark: SparkSession, docs: DataFrame, known: dict[str, bytes], text: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``rejected``.

    ``und`` with score 0 stands for a null text and one without a letter. Otherwise the
    smallest wins, ties by name; ``score`` is 0.5 at the margin of rejection and nears 1
    above it. Copies of a row get equal results; input columns named as a result give
    way to it.
    """
    share = spark.sparkContext.broadcast(known)
    kept = without(docs, RESULT)
    names = kept.columns
    schema = (
        T.StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(share.value)
        for batch in batches:
            found = [tools.name(x) for x in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in names]
            columns += [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def held_out(row_id: Column, fold: int) -> Column:
    """True where crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.pmod(F.crc32(row_id.cast("string").cast("binary")), F.lit(fold)) == 0, F.lit(False))
