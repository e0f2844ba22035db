"""Golden rows for the column functions."""

import hashlib
import html
import re
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import ids, portfolio, scoring, semistructured, text, times, vectors
from tidewire.operators import embedding, filters


def one(spark, fn, *values, schema=None):
    names = [f"c{i}" for i in range(len(values))]
    schema = schema or ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([values], schema)
    return df.select(fn(*[F.col(n) for n in names]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('["IN Economy", "ENERGY_STOCKS"]', ["IN Economy", "ENERGY_STOCKS"]),
        ("[IN Economy, ENERGY_STOCKS]", ["IN Economy", "ENERGY_STOCKS"]),
        ("A, ,B", ["A", "B"]),
        ('["a", null, "", 3]', ["a", "3"]),
        ("['a']", ["'a'"]),
        ('["a"] x', ['"a"] x']),
        ('[" "]', [""]),
        ('[0, false, true, "0", "false", 1.5, [], {}]', ["True", "0", "false", "1.5"]),
        ('{"a":1}', ['{"a":1}']),
        ('"x"', ['"x"']),
        ("  [a]\n", ["a"]),
        ("", []),
        (None, []),
        ("   ", []),
    ],
)
def test_parse_tags(spark, raw, expected):
    assert one(spark, text.parse_tags, raw) == expected


def test_tag_list(spark):
    got = one(spark, text.clean_tag_list, [" a ", None, "", "b"], schema="c0 array<string>")
    assert got == ["a", "b"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("<p>a</p><b>c&amp;d</b>", "a c&d"),
        ("&lt;b&gt; x&nbsp;y", "<b> x y"),
        ("a < b", "a < b"),
        ('<script>var t="</p>";</script>x &amp y', 'var t=" "; x & y'),
        ("a<>b <br\n/> c", "a<>b c"),
        ("a\x1cb\u0085c　d", "a b c d"),
        (None, ""),
    ],
)
def test_strip_html(spark, raw, expected):
    assert one(spark, text.strip_html, raw) == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab<>/&;ltgamp# \n \x1c1", max_size=30), min_size=20, max_size=40))
def test_strip_html_like_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", text.strip_html(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", t)).split())
        assert got[i] == want


def test_embedding_texts(spark):
    assert one(spark, text.news_embedding_text, "T", "") == "T"
    assert one(spark, text.news_embedding_text, "T", "I") == "T. I"
    assert one(spark, text.news_embedding_text, "", "I") == ". I"
    got = one(
        spark, text.user_query_text, "<b>x</b>", " ", ["A", "B"],
        schema="c0 string, c1 string, c2 array<string>",
    )
    assert got == "x. A B"
    assert one(spark, text.user_query_text, None, None, None,
               schema="c0 string, c1 string, c2 array<string>") == ""


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("1775000000000.9", 1775000000000),
        ("abc", None),
        ("1.5d", None),
        ("", None),
        (None, None),
        (" 12 ", 12),
        ("1e3", 1000),
        ("-3.9", -3),
        ("nan", None),
        ("inf", None),
        ("1e400", None),
        ("1_000", 1000),
    ],
)
def test_safe_int(spark, raw, expected):
    assert one(spark, text.safe_int, raw) == expected


def test_safe_str(spark):
    assert one(spark, text.safe_str, None) == ""
    assert one(spark, text.safe_str, " a ") == " a "
    assert one(spark, lambda c: text.safe_str(c, trim=True), " a\n") == "a"


def test_ids(spark):
    assert one(spark, ids.point_id, "1773906540622") == 1773906540622
    assert one(spark, ids.point_id, "abc") == 648541476951500027
    assert one(spark, ids.result_id, None, "", "7",) == "7"
    assert one(spark, ids.result_id, None, None) == ""


def test_blend(spark):
    def blended(q, n):
        return one(spark, scoring.blend, q, n, schema="c0 double, c1 double")

    assert blended(0.6, 0.4) == 0.5
    assert blended(0.6, 0.005) == 0.481
    assert blended(None, 0.5) == 0.25


def test_clamp(spark):
    def clamped(v):
        return one(spark, scoring.clamp, v, 0.0, 1.0, schema="c0 double, c1 double, c2 double")

    assert (clamped(-2.0), clamped(0.5), clamped(9.0)) == (0.0, 0.5, 1.0)


def test_times(spark):
    instant = datetime(2026, 4, 18, 3, 40)
    assert one(spark, times.hour_key, instant, schema="c0 timestamp") == "2026/04/18/09"
    assert one(spark, times.hourly_path, instant, schema="c0 timestamp") == "2026/04/18/et_09.json"
    cut = one(spark, times.recency_cutoff, 10 * times.DAY_MS, 7, schema="c0 bigint, c1 int")
    assert cut == 3 * times.DAY_MS
    assert one(spark, times.recency_cutoff, 5, 0, schema="c0 bigint, c1 int") is None
    date = one(spark, times.display_date, None, 1775347200000, "x y",
               schema="c0 bigint, c1 bigint, c2 string")
    assert date == "Apr 5, 2026"
    date = one(spark, times.display_date, None, None, "2026-04-05 10:00:00",
               schema="c0 bigint, c1 bigint, c2 string")
    assert date == "2026-04-05"


def test_vectors(spark):
    row = spark.createDataFrame(
        [([3.0, 4.0], [0.0, 0.0], [1.0, float("nan")], None)],
        "a array<float>, z array<float>, n array<float>, m array<float>",
    )
    got = row.select(
        vectors.l2_normalise(F.col("a")).alias("unit"),
        vectors.l2_normalise(F.col("z")).alias("zero"),
        F.round(vectors.cosine(F.col("a"), F.col("a")), 9).alias("self"),
        vectors.cosine(F.col("a"), F.col("z")).alias("none"),
        vectors.is_valid_vector(F.col("a"), 2).alias("ok"),
        vectors.is_valid_vector(F.col("a"), 3).alias("width"),
        vectors.is_valid_vector(F.col("n"), 2).alias("nan"),
        vectors.is_valid_vector(F.col("m"), 2).alias("null"),
        vectors.scoring_vector(F.col("m"), F.col("a"), F.col("z"), 2).alias("pick"),
        vectors.scoring_vector(F.col("m"), F.col("m"), F.col("m"), 2).alias("zeros"),
    ).first()
    assert [round(x, 6) for x in got["unit"]] == [0.6, 0.8]
    assert got["zero"] == [0.0, 0.0]
    assert (got["self"], got["none"]) == (1.0, 0.0)
    assert (got["ok"], got["width"], got["nan"], got["null"]) == (True, False, False, False)
    assert got["pick"] == [3.0, 4.0] and got["zeros"] == [0.0, 0.0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("{score=5, reason=oil up}", ("5", "oil up")),
        ("{note}", (None, "note")),
        ('{"score": 7, "reason": "r"}', ("7", "r")),
        ("reason=only}", ("-", "only")),
        ("score=3, reason=open", ("3", "score=3, reason=open")),
        ("", None),
        (None, None),
    ],
)
def test_economy_impact(spark, raw, expected):
    got = one(spark, semistructured.economy_impact, raw)
    assert (tuple(got) if got else got) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("[{tag=Bull, text=up}, {tag=Bear, text=down}]", [("Bull", "up"), ("Bear", "down")]),
        ('[{"tag": "A", "text": "b"}]', [("A", "b")]),
        ("[{tag=Bull text=up}]", [("Insight", "up")]),
        ("nothing here", []),
        ("", []),
        (None, []),
    ],
)
def test_perception_lines(spark, raw, expected):
    got = one(spark, semistructured.perception_lines, raw)
    assert [tuple(r) for r in got] == expected


def test_impact_matrix(spark):
    printed = (
        "[{type=Sector, entity=[{name=Oil, score=4, reason=cuts, perception_line=firm}, "
        "{name=Air, score=2, reason=fuel, perception_line=weak}]}, {type=Empty, entity=[]}]"
    )
    got = one(spark, semistructured.impact_matrix, printed)
    assert [(t["type"], [tuple(e) for e in t["entity"]]) for t in got] == [
        ("Sector", [("Oil", "4", "cuts", "firm"), ("Air", "2", "fuel", "weak")])
    ]
    loose = one(spark, semistructured.impact_matrix, "type=X name=Y, score=1")
    assert [(t["type"], [tuple(e) for e in t["entity"]]) for t in loose] == [
        ("Entity", [("Y", "-", "No specific reason provided.", "")])
    ]
    listed = one(
        spark, semistructured.impact_matrix,
        '[{"type":"S","entity":[{"name":"n","score":"1","reason":"r","perception_line":"p"}]}]',
    )
    assert [tuple(e) for e in listed[0]["entity"]] == [("n", "1", "r", "p")]
    assert one(spark, semistructured.impact_matrix, None) == []


def held(*holdings):
    items = ",".join(holdings)
    body = items if len(holdings) == 1 else f"[{items}]"
    return f'{{"summary":{{"investment":{{"holdings":{{"holding":{body}}}}}}}}}'


def test_portfolio_text(spark):
    def text_of(doc, interests=""):
        return one(spark, lambda d, i: portfolio.portfolio_text(portfolio.sections_of(d), i), doc, interests)

    doc = (
        '{"REIT":{"r1":' + held('{"issuerName":"X"}') + '},'
        '"EQUITIES":{"e1":' + held('{"issuerName":"X","description":null}') + "}}"
    )
    assert text_of(doc) == (
        "X. Indian stock market equities shares. real estate investment trust REIT"
    )
    assert text_of("{}") == ""
    assert text_of(None) == ""
    assert text_of("{}", " gold ") == "gold"
    doc = '{"DEPOSIT_V2":{"summary":[{"accountType":"SAVINGS","facility":"null"}]}}'
    assert text_of(doc) == "SAVINGS account. bank savings deposit interest rate"
    doc = (
        '{"SIP":{"s":' + held('{"amc":"","issuerName":"H","schemeCode":"S1"}', '{"amc":"null","issuerName":"Z"}')
        + '},"INSURANCE_POLICIES":{"p":{"summary":{"policyName":"Shield","policyType":"TERM_PLAN",'
        '"coverType":"LIFE"}},"bad":7},"INVIT":{"i":' + held('{"issuerName":"Grid"}') + '},"OTHER":{"x":1}}'
    )
    assert text_of(doc) == (
        "H. S1. Grid. Shield. term plan. LIFE. mutual funds SIP investment. "
        "infrastructure investment trust InvIT. insurance life cover financial planning"
    )
    assert text_of('{"EQUITIES":null}') == "Indian stock market equities shares"


def test_portfolio_keeps_account_order(spark):
    doc = (
        '{"EQUITIES":{"E1":' + held('{"issuerName":"b"}') + ',"E0":' + held('{"issuerName":"a"}') + "}}"
    )
    row = spark.createDataFrame([(doc, "")], "portfolio string, interests string")
    got = portfolio.with_portfolio_text(row).first()["query_text"]
    assert got.startswith("b. a. ")


def test_section_counts(spark):
    doc = '{"EQUITIES":{"a":{},"b":{}},"DEPOSIT_V2":{"summary":[{},{},{}]},"REIT":{}}'
    got = one(spark, lambda d: portfolio.section_counts(portfolio.sections_of(d)), doc)
    assert (got["deposits"], got["equities"], got["reit"], got["sip"]) == (3, 2, 0, None)


def test_encoder_runs_once_below_a_filter_on_its_vectors(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id int, t string").repartition(2)
    rows = embedding.embed(df, {"v": F.col("t")}, embedding.HashingEncoder(8), seen=calls)
    same = rows.select("id", F.col("v").alias("a"), F.col("v").alias("b")).where(F.col("a") == F.col("b"))
    assert same.count() == 20 and len(same.collect()) == 20
    before = calls.value
    same.select("id", "a").collect()
    assert calls.value - before == 20


def test_words_of_ascii_texts_are_those_of_the_pattern():
    encode = embedding.HashingEncoder(16).load()
    texts = ["A_b c1-D\x1c\x1fe\x00f", "", "_ _", "".join(map(chr, range(128))), "Élan_vital İx ² ½ 漢字 a"]
    for text, got in zip(texts, encode(texts), strict=True):
        want = np.zeros(16)
        for word in re.findall(r"[^\W_]+", text.lower()):
            digest = hashlib.md5(word.encode()).hexdigest()
            want[int(digest[:8], 16) % 16] += 1 if int(digest[8], 16) % 2 == 0 else -1
        length = np.sqrt((want * want).sum())
        assert (got == (want / (length or 1)).astype(np.float32)).all()


def test_white_space_is_trimmed_whatever_its_kind(spark):
    signs = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000] + ["﻿"]
    df = spark.createDataFrame([(f"{c} a{c}b{c}{c}",) for c in signs] + [("",), (None,)], "t string")
    old = F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    assert df.where(~old.eqNullSafe(text.strip_space(F.col("t")))).isEmpty()


def test_a_filter_on_the_text_parses_a_document_once(spark, capsys):
    df = spark.createDataFrame([("1", '{"EQUITIES":{}}', ""), ("2", "{}", " \t"), ("3", None, None)], "request_id string, portfolio string, interests string")
    _, rejected = filters.split_blank(portfolio.with_portfolio_text(df), "query_text")
    assert sorted(r["request_id"] for r in rejected.collect()) == ["2", "3"]
    rejected.select("request_id").explain()
    assert len(re.findall(r"from_json\(MapType\([^()]*\), portfolio#", capsys.readouterr().out)) == 1


def test_the_text_that_is_searched_for_is_made_once(spark, capsys):
    """Once for the filter on blank texts and whoever reads the accepted ones."""
    df = spark.createDataFrame([("1", '{"EQUITIES":{}}', ""), ("2", "{}", " \t"), ("3", None, "gold")], "request_id string, portfolio string, interests string")
    accepted, _ = filters.split_blank(portfolio.with_portfolio_text(df), "query_text")
    assert sorted(r["request_id"] for r in accepted.collect()) == ["1", "3"]
    accepted.select("request_id", "query_text").explain()
    assert len(re.findall(r"from_json\(MapType\([^()]*\), portfolio#", capsys.readouterr().out)) == 1
