"""Quality rules, mixing and license scans on awkward rows, against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidewire.llm import licenses, mixing, quality
from tidewire.llm.words import space_words


def _measures(text):
    w = cases.space_words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if cases.space_words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit))


def test_quality_measures(spark):
    for df in (cases.docs(spark), cases.clashing(cases.docs(spark))):
        got = quality.judge(df).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert len(got) == len(cases.ROWS)
        for r in got:
            m = _measures(r.text)
            assert tuple(r)[1:6] == m
            assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
            assert not (r.kept and r.base_failed)


def test_quality_verdicts(spark):
    kept = {r.doc_id for r in quality.keep(cases.docs(spark)).collect()}
    assert {1, 2, 3, 14, 15} <= kept
    assert not kept & {4, 5, 6, 7, 10, 11, 13}
    assert quality.keep(cases.docs(spark)).columns == cases.DOCS.names
    assert quality.keep(cases.docs(spark, [])).collect() == []
    assert quality.keep(cases.clashing(cases.docs(spark))).columns == cases.clashing(cases.docs(spark)).columns
    only_base = quality.judge(cases.docs(spark), rules=()).where("not base_failed")
    assert only_base.where("not kept").count() == 0


def _targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        share = sum(w[s] for s in free)
        level = (total - sum(most * sizes[s] for s in full)) / share if share else 0
        above = {s for s in free if w[s] * level > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else w[s] * level for s in order}
        full |= above


@pytest.mark.parametrize("copies", [1, 40])
def test_mixing(spark, copies):
    rows = [((i * 1000 + k) if i is not None and copies > 1 else i, *rest) for k in range(copies) for i, *rest in cases.ROWS]
    df = cases.clashing(cases.docs(spark, rows)).withColumn("words", F.size(space_words(F.col("text"))))
    got = mixing.mix(spark, df, F.col("words")).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), defaultdict(int)
    for r in got:
        assert r["size"] == len(cases.space_words(r.text))
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    want = _targets(sizes)
    largest = max(r["size"] for r in got)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    if copies > 1:
        for s in sizes:
            big = max((r["size"] for r in got if r.source == s), default=0)
            assert abs(taken[s] - want[s]) <= max(big, 1) <= largest
    again = mixing.mix(spark, df.repartition(7), F.col("words")).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mixing_without_words(spark):
    words = F.size(space_words(F.col("text")))
    assert mixing.mix(spark, cases.docs(spark, []), words).collect() == []
    none = mixing.mix(spark, cases.docs(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)]), words).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0), (0.0, 0)]


def _license(text):
    w = cases.sign_words(text)
    at = defaultdict(list)
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at[label] += [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    every = [i for v in at.values() for i in v]
    base = {k for k, v in at.items() if v}
    found, best = set(base), 1.0 if every else 0.0
    held = set(w)
    for label, notice in licenses.TEMPLATES:
        t = set(licenses.template_words(notice))
        span = -(-5 * len(cases.sign_words(notice)) // 4)
        if len(held & t) >= 0.9 * len(t) - 1e-9:
            most = max(len(set(w[i : i + span]) & t) for i in range(len(w)))
            if most >= 0.9 * len(t) - 1e-9:
                found.add(label)
                best = max(best, most / len(t))
    return (len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(found)), best)


def test_licenses(spark):
    more = [
        (100 + i, f"{before}{notice}{after}", None, None, None)
        for i, (_, notice) in enumerate(licenses.TEMPLATES)
        for before, after in [("", ""), ("Foo bar. ", " And more\nlines.")]
    ] + [(200, "gnu GENERAL public license mit license cc by cc BY", None, None, None), (201, "apache\nlicense", None, None, None)]
    more += [(300 + i, notice.replace(" ", "\n * ", 1 + i % 3).replace(" and ", " and then ", 1), None, None, None) for i, (_, notice) in enumerate(licenses.TEMPLATES)]
    for df in (cases.docs(spark, cases.ROWS + more), cases.clashing(cases.docs(spark, cases.ROWS))):
        got = licenses.scan(spark, df).select("text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
        assert len(got) == df.count()
        for r in got:
            assert tuple(r)[1:7] == _license(r.text)[:6]
            assert r.score == pytest.approx(_license(r.text)[6])
    assert licenses.scan(spark, cases.docs(spark, [])).collect() == []


def test_notices_over_lines(spark):
    wrapped = "/* This library is free software; you can redistribute it\n * and/or modify it under the terms of\n * the GNU Lesser General Public\n * License as published by the\n * Free Software Foundation\n */"
    texts = {
        "This is free and unencumbered software\nreleased into the public domain.": "unlicense",
        "All rights\nreserved.": "all-rights-reserved",
        wrapped: "lgpl",
        "All the boats left. Nobody kept any rights, but the town reserved a place": "",
        "rights " * 3000 + "all reserved": "all-rights-reserved",
        "reserved " * 50_000: "",
        "all " * 30_000 + "rights " * 30_000 + "reserved " * 30_000: "",
    }
    docs = cases.docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r.text: r.labels for r in licenses.scan(spark, docs).collect()}
    for text, label in texts.items():
        assert (label in got[text].split(",")) if label else got[text] == "", text[:80]
