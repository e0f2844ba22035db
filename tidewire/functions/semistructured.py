"""Columns that hold JSON, or the text a struct prints as, to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.schemas import ECONOMY_IMPACT, IMPACT_MATRIX, PERCEPTION_LINES

# Field markers of the printed form and the texts that stand in
# for a missing field.
_SCORE_THEN_REASON = r"score=(.*?),\s*reason="
_REASON_TO_BRACKET = r"reason=(.*?)(?:\}|\])"
_TAG_THEN_TEXT = r"^(.*?),\s*text="
_TEXT_TO_BRACKET = r"text=(.*?)(?:\}|\])"
_TYPE_THEN_ENTITY = r"^(.*?),\s*entity=\["
_NAME_THEN_SCORE = r"^(.*?),\s*score="
_REASON_THEN_PERCEPTION = r"reason=(.*?),\s*perception_line="
_PERCEPTION_TO_BRACKET = r"perception_line=(.*?)(?:\}|\])"
DEFAULT_TAG = "Insight"
DEFAULT_TYPE = "Entity"
DEFAULT_VALUE = "-"
DEFAULT_REASON = "No specific reason provided."


def _field(text: Column, pattern: str, default: Column) -> Column:
    """First match of a marker, or the default when the marker is absent."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(
        default
    )


def _has(text: Column, *patterns: str) -> Column:
    return F.array_max(F.array(*[F.regexp_like(text, F.lit(p)) for p in patterns]))


def _without_first_brace(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^([^}]*)\}", "$1")


def _after_marker(text: Column, marker: str) -> Column:
    """The pieces that follow each occurrence of a marker."""
    pieces = F.split(text, marker)
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _is_json_list(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>").isNotNull()


def economy_impact(text: Column) -> Column:
    """``{score=.., reason=..}`` or JSON to a struct; other text is the reason."""
    dash = F.lit(DEFAULT_VALUE)
    printed = F.when(
        _has(text, _SCORE_THEN_REASON, _REASON_TO_BRACKET),
        F.struct(
            _field(text, _SCORE_THEN_REASON, dash).alias("score"),
            _field(text, _REASON_TO_BRACKET, _without_first_brace(text)).alias("reason"),
        ),
    ).otherwise(
        F.struct(
            F.lit(None).cast("string").alias("score"),
            F.regexp_replace(text, r"[{}]", "").alias("reason"),
        )
    )
    return F.when(
        text != "",
        F.when(_is_json(text), F.from_json(text, ECONOMY_IMPACT)).otherwise(printed),
    )


def perception_lines(text: Column) -> Column:
    """``[{tag=.., text=..}, ..]`` or a JSON list to tag and text pairs."""
    blocks = F.filter(
        _after_marker(text, "tag="), lambda b: _has(b, _TAG_THEN_TEXT, _TEXT_TO_BRACKET)
    )
    printed = F.transform(
        blocks,
        lambda b: F.struct(
            _field(b, _TAG_THEN_TEXT, F.lit(DEFAULT_TAG)).alias("tag"),
            _field(b, _TEXT_TO_BRACKET, _without_first_brace(b)).alias("text"),
        ),
    )
    parsed = F.when(_is_json_list(text), F.from_json(text, PERCEPTION_LINES))
    return F.coalesce(parsed, printed, F.array().cast(PERCEPTION_LINES))


def impact_matrix(text: Column) -> Column:
    """``[{type=.., entity=[{name=.., ..}]}, ..]`` or a JSON list to nested structs."""
    dash = F.lit(DEFAULT_VALUE)

    def entities(block: Column) -> Column:
        named = F.filter(
            _after_marker(block, "name="), lambda e: _has(e, _NAME_THEN_SCORE, _SCORE_THEN_REASON)
        )
        return F.transform(
            named,
            lambda e: F.struct(
                _field(e, _NAME_THEN_SCORE, dash).alias("name"),
                _field(e, _SCORE_THEN_REASON, dash).alias("score"),
                _field(e, _REASON_THEN_PERCEPTION, F.lit(DEFAULT_REASON)).alias("reason"),
                _field(e, _PERCEPTION_TO_BRACKET, F.lit("")).alias("perception_line"),
            ),
        )

    typed = F.transform(
        _after_marker(text, "type="),
        lambda b: F.struct(
            _field(b, _TYPE_THEN_ENTITY, F.lit(DEFAULT_TYPE)).alias("type"),
            entities(b).alias("entity"),
        ),
    )
    printed = F.filter(typed, lambda t: F.size(t["entity"]) > 0)
    parsed = F.when(_is_json_list(text), F.from_json(text, IMPACT_MATRIX))
    return F.coalesce(parsed, printed, F.array().cast(IMPACT_MATRIX))


def nested_as_json(c: Column, keep_nulls: bool = False) -> Column:
    """A nested column as JSON text."""
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return F.to_json(c, options)
