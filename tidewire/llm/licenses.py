"""License scans: an exact set-similarity join of text blocks to license notices.

A block is a run of words as long as a notice and a quarter more, wherever its lines
break; block and template are sets of words. A template is found where a block holds at
least THRESHOLD of its words. The words of all templates are ordered by how many
documents of the whole corpus hold them, rarest first; to reach the threshold a block
must hold one of the first few words of the template (prefix filter). Around such words,
only template words within a block's reach of one count (positional), and there must be
enough of them (length); then the blocks there are verified.

All of it is column expressions and joins. The templates are fixed, so is what is
broadcast; texts are scanned, never shuffled. A stretch of a text is looked at once per
template, however often a word repeats there.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.words import SIGNS, lower_ascii, sign_words, without
from tidewire.session import Scratch

THRESHOLD = 0.9

# Phrases whose words stand one behind the other, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices by which works name their license, and the labels given to them.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
            "GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the "
             "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software under the terms of the GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the "
               "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "The person has dedicated the work to the public domain under CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def all_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_words(text: str) -> list[str]:
    """Distinct words of a notice, sorted."""
    return sorted(set(all_words(text)))


def block_words(text: str) -> int:
    """Words of a block that may hold a notice."""
    return -(-5 * len(all_words(text)) // 4)


@dataclass(frozen=True)
class Template:
    label: str
    ranks: list[int]
    need: int
    span: int

    @property
    def prefix(self) -> list[int]:
        return self.ranks[: len(self.ranks) - self.need + 1]


def word_order(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> list[str]:
    """The templates' words by the number of documents that hold them, then by word."""
    known = sorted({w for _, notice in templates for w in template_words(notice)})
    vocabulary = F.array(*[F.lit(w) for w in known])
    held = F.array_intersect(sign_words(lower_ascii(F.col(f"`{text}`"))), vocabulary)
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}  # one row per template word
    return sorted(known, key=lambda w: (found.get(w, 0), w))


def ranked(order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    at = {w: i + 1 for i, w in enumerate(order)}
    sets = [(label, sorted(at[w] for w in template_words(notice)), block_words(notice)) for label, notice in templates]
    return [Template(label, ranks, math.ceil(round(threshold * len(ranks), 9)), span) for label, ranks, span in sets]


def matches(
    spark: SparkSession, docs: DataFrame, order: list[str], templates: list[Template], key: Column, text: str = "text"
) -> DataFrame:
    """(key, label, share) of every template that a block holds, once per stretch of the text.

    A stretch is as long as the longest block. Its first prefix word stands for all of
    it, and takes along the template words that a block of any of them can reach; a place
    has one word, so they are few.
    """
    prefix = sorted({r for t in templates for r in t.prefix})
    other = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pattern = f"(?i)(?<!{other})(?:{'|'.join(order[r - 1] for r in prefix)})(?!{other})"
    vocabulary, long = F.array(*[F.lit(w) for w in order]), max(t.span for t in templates)
    # the templates that have a rank in their prefix, by rank
    named = F.array(*[
        F.array(*[F.lit(n) for n, t in enumerate(templates) if r in t.prefix]).cast("array<int>") for r in range(1, len(order) + 1)
    ])
    some = docs.where(F.col(f"`{text}`").rlike(pattern))
    words = some.select(key.alias("_key"), F.array_remove(F.split(lower_ascii(F.col(f"`{text}`")), SIGNS), "").alias("words"))
    known = words.withColumn("at", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(order), i))))
    hits = known.select(
        "_key",
        F.transform(
            "at", lambda i: F.struct(i.alias("at"), F.array_position(vocabulary, F.get("words", i)).cast("int").alias("rank"))
        ).alias("hits"),
    )
    rare = hits.withColumn("rare", F.array_compact(F.transform("hits", lambda h, k: F.when(h["rank"].isin(prefix), k))))

    def stretch(k: Column) -> Column:
        return F.floor(F.get("hits", k)["at"] / long)

    heads = F.filter("rare", lambda k, i: (i == 0) | (stretch(k) != stretch(F.get("rare", F.greatest(i - 1, F.lit(0))))))
    around = F.transform(
        heads,
        lambda k: F.struct(F.get("hits", k)["at"].alias("at"), F.slice("hits", F.greatest(k - long, F.lit(0)) + 1, 3 * long + 1).alias("near")),
    )
    held = rare.select("_key", F.explode(around).alias("x")).select("_key", "x.at", "x.near")
    ranks = F.transform(
        F.filter("near", lambda h: (h["at"] >= F.col("at")) & (h["at"] < F.col("at") + long)), lambda h: h["rank"]
    )
    asked = F.array_distinct(F.flatten(F.transform(F.array_distinct(ranks), lambda r: F.get(named, r - 1))))
    table = spark.createDataFrame(
        [(n, t.label, len(t.ranks), t.need, t.span, t.ranks) for n, t in enumerate(templates)],
        "template int, label string, size int, need int, span int, ranks array<int>",
    )
    met = held.withColumn("template", F.explode(asked)).join(F.broadcast(table), "template")
    reach = F.filter(
        "near",
        lambda h: (h["at"] > F.col("at") - F.col("span")) & (h["at"] < F.col("at") + long + F.col("span"))
        & F.array_contains("ranks", h["rank"]),
    )
    met = met.withColumn("near", reach).where(F.size(F.array_distinct("near.rank")) >= F.col("need"))

    def shared(start: Column) -> Column:
        inside = F.filter("near", lambda h: (h["at"] >= start["at"]) & (h["at"] < start["at"] + F.col("span")))
        return F.size(F.array_distinct(F.transform(inside, lambda h: h["rank"])))

    most = F.array_max(F.transform(F.filter("near", lambda h: h["at"] < F.col("at") + long), shared))
    found = met.withColumn("most", most).where(F.col("most") >= F.col("need"))
    return found.select("_key", "label", (F.col("most") / F.col("size")).alias("share"))


def _starts(words: Column, phrase: str) -> Column:
    """Places at which the phrase begins, from 0."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.when(F.size(words) >= len(parts), F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def scan(spark: SparkSession, docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Every row with its words, base places, labels of phrases and of notices, and score.

    ``score`` is 1 with a base phrase, else the best share of a notice that a block holds,
    at least the threshold, else 0. A null text is empty: no words, null places, empty
    labels. Rows of equal id and text are scanned once and get equal results; input
    columns named as a result give way to it.
    """
    scratch = Scratch(spark, "licenses")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.xxhash64(F.col(f"`{row_id}`"), body)
    order = word_order(docs, text=text)
    found = matches(spark, docs, order, ranked(order), key, text)
    notices = scratch.keep(
        found.groupBy("_key").agg(F.collect_set("label").alias("_found"), F.max("share").alias("_share")), "notices"
    )
    kept = without(docs, RESULT)
    heads = "|".join(sorted({p.split()[0] for p in PHRASES}))
    lowered = F.split(lower_ascii(body), SIGNS)
    words = F.when(body.rlike(f"(?i){heads}"), F.array_remove(lowered, ""))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept.columns], key.alias("_key"),
        F.size(sign_words(body)).cast("bigint").alias("n_words"), words.alias("_words"),
    )
    places = {label: f"_at{i}" for i, label in enumerate(PHRASES.values())}
    rows = rows.withColumns({places[v]: _starts(F.col("_words"), k) for k, v in PHRASES.items()})
    every = F.concat(*[F.coalesce(p, F.array().cast("array<int>")) for p in places.values()])
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in places.items()]))
    rows = rows.withColumns({"_every": every, "_base": base}).join(notices, "_key", "left")
    none = F.array().cast("array<string>")
    labels = F.array_union("_base", F.coalesce("_found", none))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept.columns], "n_words",
        F.size("_every").cast("bigint").alias("n_base"),
        F.array_min("_every").cast("bigint").alias("first_word"),
        F.array_max("_every").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("_every") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
