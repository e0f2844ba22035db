"""Awkward rows that every operator must take, and plain versions of what they compute."""

import re

from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
PROSE = (
    "The river was wide and the boats that crossed it in the morning were slow. People of the town "
    "waited for the ferry with baskets of bread, and from the hill a bell was heard. It rang for the "
    "market, for the school and for the end of the day, as it had done since the bridge fell in. "
    "Nobody was in a hurry; the water had time, and so had they."
)
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000)) + ". " + PROSE
ROWS = [
    (1, PROSE, "en", "a", len(PROSE)),
    (2, PROSE, "en", "a", len(PROSE)),  # equal text
    (3, PROSE.replace("ferry", "barge"), "en", None, None),  # near copy
    (3, PROSE.replace("ferry", "barge"), "en", None, None),  # the same row again
    (4, None, None, "b", None),
    (5, "", "en", "", 0),
    (6, " \t\n\x0b\x0c\r ", None, "b", 7),
    (None, PROSE.upper(), "en", "a", 5),  # null id
    (None, None, None, None, None),
    (7, "one two", "en", "c", 7),
    (8, "One TWO", "fr", "c", 7),
    (9, LONG, "en", "long", len(LONG)),
    (10, "### $$$ ||| &&& %%%\n" * 30, "de", "junk", 600),
    (11, "same line here\n" * 40, "en", "junk", 600),
    (12, "Ünïcödé 漢字 \U0001f600 straße ÉCOLE " * 20, "de", "b", 700),
    (13, "x" * 200_000, None, "long", 200_000),
    (14, PROSE + " Licensed under CC BY-NC 4.0.\nAll rights reserved.", "en", "b", 1),
    (15, "Mail ann.lee42@mail7.example.com or +1 (269) 555-3296, card 4524132264652876. " + PROSE, "en", "b", 1),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    """More columns, named like results and helpers of the operators."""
    out = df
    for name in "size kept n_words score component_id spans labels taken n_hit lang_pred node n_found".split():
        out = out.selectExpr("*", f"'{name}' AS {name}")
    return out


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def sign_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(text, n):
    w = space_words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def linked(rows, n, percent):
    """Per row the rows reached by links."""
    sets = [shingles(t, n) for t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group
