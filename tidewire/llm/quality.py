"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a column expression of the text alone and every rule a comparison
of two measures, so judging a corpus is one scan without shuffle, Python or state:
what a lost executor held is computed again from its split of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import WORD, space_words, without

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it of on or that the this to was were "
    "which with "
    "au aux avec ce ces dans de des du elle en est et il la le les ne ou par pas pour que qui "
    "sur un une "
    "als auf aus das dem den der des die ein eine er es ist im mit nicht sich sie und von zu "
    "al como con del el es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``of / per`` must lie within ``least`` and ``most``; a bound of None is open."""

    name: str
    of: str
    per: str
    least: float | None = None
    most: float | None = None

    def holds(self) -> Column:
        """True within the bounds; a document without the divisor passes."""
        of, per = F.col(self.of), F.col(self.per)
        kept = F.lit(True)
        if self.least is not None:
            kept = kept & (of >= F.lit(self.least) * per)
        if self.most is not None:
            kept = kept & (of <= F.lit(self.most) * per)
        return kept


# The thresholds in use. Lengths are in code points.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated_lines_per_line", "n_dup_lines", "n_lines", None, 0.5),
)
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_stop_words",
]
RESULT = [*MEASURES, "base_failed", "failed_rules", "kept"]
LEAST_WORDS = 50


def _repeated(words: Column) -> Column:
    """Words inside windows of three that occur twice or more in these words.

    Windows are sorted by a 64-bit hash; equal neighbours are repeats. Their places,
    in order, cover three words each, less what the next one covers as well.
    """
    windows = F.slice(
        F.transform(
            words,
            lambda w, i: F.struct(
                F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")
            ),
        ),
        1,
        F.greatest(F.size(words) - 2, F.lit(0)),
    )
    return F.sort_array(windows)


def _places(ordered: Column) -> Column:
    twice = F.filter(
        ordered,
        lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]),
    )
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def _covered(places: Column) -> Column:
    return F.aggregate(
        F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, n: total + n,
    )


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its measures; input columns of the same names give way.

    A null text has no words, lines or symbols. A line is a ``\\n``-split part with a
    word, and repeats if it equals an earlier one. Copies of a row have equal measures.

    The measures leave through a generator of one row: a filter on them would else be
    pushed into the scan with a copy of their expressions for each place that reads them.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = without(docs, RESULT)
    columns = [F.col(f"`{c}`") for c in kept.columns]
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    return (
        kept.withColumns({"_words": space_words(body), "_lines": lines})
        .withColumn("_windows", _repeated(F.col("_words")))
        .withColumn("_places", _places(F.col("_windows")))
        .select(
            *columns,
            F.inline_outer(
                F.array(
                    F.struct(
                        F.size("_words").cast("bigint").alias("n_words"),
                        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
                        F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
                        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
                        _covered(F.col("_places")).alias("n_repeat_words"),
                        F.size("_lines").cast("bigint").alias("n_lines"),
                        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS)))
                        .cast("bigint").alias("n_stop_words"),
                    )
                )
            ),
        )
    )


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row with its measures, ``base_failed``, ``failed_rules`` and ``kept``.

    The base fails below 50 words, or if more than half of the words lie in repeated
    windows of three. Documents that pass are held against ``rules``.
    """
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    if not rules:
        failed = F.array().cast("array<string>")
    return (
        measures(docs, text)
        .withColumns({"base_failed": base_failed, "failed_rules": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with the columns they came with and in their order."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text"))
    return judge(rows, "_text", rules).where("kept").select("_row.*")
