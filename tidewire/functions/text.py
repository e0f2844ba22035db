"""Text cleaning, tag parsing and the texts that get embedded."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space (the Unicode property plus the four
# information separators), as a pattern and as a list, and the shape of a tag.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_TAG = r"<[^>]+>"
_ENTITY = r"&(#|[A-Za-z])"


def strip_space(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.trim(c, F.lit(WHITE))


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


@F.pandas_udf(T.StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def strip_html(c: Column) -> Column:
    """Tags become blanks, then entities are decoded, then space is collapsed.

    Python sees only the texts that hold an entity; for the others the argument
    is null, so nothing but a null crosses to the worker. Patterns run only over
    texts with the sign that they begin with.
    """
    text = F.coalesce(c, F.lit(""))
    bare = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, _TAG, " ")).otherwise(text)
    decoded = _decode_entities(F.when(F.contains(bare, F.lit("&")) & bare.rlike(_ENTITY), bare))
    return _collapse(F.coalesce(decoded, bare))


def parse_tags(c: Column) -> Column:
    """A JSON list, or a bracketed comma list, to an array of trimmed tags.

    In a JSON list null, empty, zero and false items go before trimming; in the
    comma form empty items go after it.
    """
    text = strip_space(F.coalesce(c, F.lit("")))
    listed = F.when(
        text.rlike(r"(?s)^\[.*\]$"),
        F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"),
    )

    def is_kept(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        value = v.cast("string")
        number = F.try_variant_get(v, "$", "double")
        return (
            F.when(kind == "VOID", F.lit(False))
            .when(kind == "STRING", value != "")
            .when(kind == "BOOLEAN", value == "true")
            .when(number.isNotNull(), number != 0)
            .otherwise(~value.isin("[]", "{}"))
        )

    def as_text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "BOOLEAN", F.lit("True")).otherwise(
            strip_space(v.cast("string"))
        )

    from_json_list = F.transform(
        F.filter(listed, lambda v: F.coalesce(is_kept(v), F.lit(False))), as_text
    )
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    from_commas = F.filter(F.transform(F.split(inner, ","), strip_space), lambda t: t != "")
    return F.coalesce(from_json_list, from_commas)


def clean_tag_list(c: Column) -> Column:
    """The list form: drop null and empty tags, trim the rest."""
    kept = F.filter(c, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.transform(kept, strip_space), F.array().cast("array<string>"))


def tags_as_text(tags: Column) -> Column:
    return F.array_join(tags, " ")


def news_embedding_text(title: Column, intro: Column) -> Column:
    """``T. I``, or ``T`` when there is no introduction.

    Both are named in one place only, so that each is cleaned once.
    """
    present = F.filter(F.array(strip_html(intro)), lambda i: i != "")
    return F.array_join(F.concat(F.array(strip_html(title)), present), ". ")


def user_query_text(clicked: Column, interests: Column, categories: Column) -> Column:
    parts = F.array(
        strip_html(clicked),
        strip_html(interests),
        F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " "),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), ". ")


def truncate(c: Column, max_chars: int = 8192) -> Column:
    """The first ``max_chars`` code points, for encoders with a bounded context."""
    return F.substring(c, 1, max_chars)


def summary(intro: Column, max_chars: int = 1000) -> Column:
    return truncate(strip_html(intro), max_chars)


def safe_str(c: Column, trim: bool = False) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return strip_space(text) if trim else text


# Fixed value: the decimal number texts that count as numbers.
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def safe_int(c: Column) -> Column:
    """Number text, truncated toward zero; anything else is null."""
    text = strip_space(c.cast("string"))
    number = F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))
    return number.try_cast("bigint")


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)
