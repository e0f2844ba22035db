"""Stable ids and content keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def point_id(article_id: Column) -> Column:
    """Integer text as it is, anything else the first 60 bits of its MD5."""
    text = article_id.cast("string")
    number = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
    return F.coalesce(number, hex_to_long(F.substring(F.md5(text), 1, 15)))


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def seeded_order(seed: int, *keys: Column) -> Column:
    """A reproducible pseudo-random sort key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_long(seed: int, *keys: Column) -> Column:
    """A reproducible pseudo-random number of 60 bits."""
    return hex_to_long(F.substring(seeded_order(seed, *keys), 1, 15))


def result_id(*candidates: Column) -> Column:
    """The first id that is present and not empty, else the empty text."""
    texts = [F.when(c.cast("string") != "", c.cast("string")) for c in candidates]
    return F.coalesce(*texts, F.lit(""))
