"""Raw rows to articles, payloads and typed articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import semistructured, text
from tidewire.schemas import ARTICLE_COLUMNS, ARTICLE_TEXT_COLUMNS, HOURLY_ARTICLE, NESTED_COLUMNS


def known_columns(df: DataFrame) -> DataFrame:
    """Trim header names and keep the known columns; absent ones become null."""
    named = df.toDF(*[c.strip() for c in df.columns])
    return named.select(
        *[
            F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c)
            for c in ARTICLE_COLUMNS
        ],
        *[c for c in named.columns if c.startswith("_")],
    )


def normalise(df: DataFrame, trim: bool = False) -> DataFrame:
    """Twelve texts, never null, and one number or null.

    Columns whose name starts with an underscore, such as a sequence number,
    pass through.
    """
    return df.select(
        *[text.safe_str(F.col(c), trim).alias(c) for c in ARTICLE_TEXT_COLUMNS],
        text.safe_int(F.col("published_time_unix")).alias("published_time_unix"),
        *[c for c in df.columns if c.startswith("_")],
    )


def nested_to_text(df: DataFrame) -> DataFrame:
    """The lake form with its nested columns as JSON text."""
    return df.withColumns({c: semistructured.nested_as_json(F.col(c)) for c in NESTED_COLUMNS})


def with_id(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") != "")


def payload(articles: DataFrame) -> DataFrame:
    """The light columns stored next to the vectors."""
    return articles.select(
        F.col("id").alias("article_id"),
        "title",
        text.summary(F.col("introductory_paragraph")).alias("summary"),
        text.parse_tags(F.col("tags")).alias("tags"),
        F.col("published_time_unix").alias("timestamp"),
    )


def typed(articles: DataFrame) -> DataFrame:
    """Semi-structured text columns as typed nested columns."""
    return articles.withColumns(
        {
            "economyimpact": semistructured.economy_impact(F.col("economyimpact")),
            "perception_lines": semistructured.perception_lines(F.col("perception_lines")),
            "impact_matrix": semistructured.impact_matrix(F.col("impact_matrix")),
            "tags": text.parse_tags(F.col("tags")),
        }
    )


def hourly_parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles of hourly files, one by one, and quarantine rows of those that fail.

    ``files`` has ``articles``, a list of JSON texts, and the path of the file as
    ``file``. A good article is ``a``, with ``file`` and its ``place`` in the list. An
    element that is no object, or a field of another type, fails that article alone.
    """
    told = files.select("file", F.posexplode("articles").alias("place", "text"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = told.withColumn("a", F.from_json("text", HOURLY_ARTICLE, options))
    good = F.col("a").isNotNull() & F.col("a._corrupt_record").isNull() & F.col("text").rlike(r"^\s*\{")
    bad = parsed.where(~F.coalesce(good, F.lit(False))).select(
        F.concat_ws("-", "file", "place").alias("id"),
        F.lit("unreadable article").alias("reason"),
        F.col("text").alias("record"),
    )
    return parsed.where(good).select("file", "place", "a"), bad


def hourly_items(placed: DataFrame) -> DataFrame:
    """Parsed articles of hourly files, flattened, with the fallbacks for title and id.

    A missing id becomes the file and the place in it, which is the same on every
    reading; both, as ``_file`` and ``_at``, give the source order.
    """
    fd = F.col("a.formatted_data")
    blank = F.lit("")
    given = text.none_if_empty(F.col("a.id"))
    stamp = F.unix_millis(F.coalesce(*[
        F.try_to_timestamp(F.col("a.published_time"), F.lit(f)) for f in _PUBLISHED_FORMATS
    ]))
    return placed.select(
        F.coalesce(given, F.concat_ws("-", "file", "place")).alias("article_id"),
        F.coalesce(
            text.none_if_empty(fd["title"]), text.none_if_empty(F.col("a.original_title")), blank
        ).alias("title"),
        F.coalesce(fd["descriptive_paragraph"], blank).alias("description"),
        F.coalesce(fd["tags"], F.array().cast("array<string>")).alias("tags"),
        F.col("a.published_time").alias("published_time"),
        fd["economyImpact"]["score"].alias("economy_impact"),
        stamp.alias("timestamp"),
        F.col("file").alias("_file"),
        F.col("place").alias("_at"),
    )


# Forms in which a publish time is written.
_PUBLISHED_FORMATS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]X",
]
