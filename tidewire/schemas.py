"""Schemas of the article, request and vector tables."""

from pyspark.sql import types as T

# Fixed column names of the article table, in file order.
ARTICLE_TEXT_COLUMNS = [
    "id",
    "published_time",
    "title",
    "introductory_paragraph",
    "descriptive_paragraph",
    "historical_context",
    "economyimpact",
    "impact_matrix",
    "perception_lines",
    "tags",
    "ai_image_prompt",
    "processed_at",
]
ARTICLE_COLUMNS = ARTICLE_TEXT_COLUMNS + ["published_time_unix"]
REQUIRED_COLUMNS = ["id", "title"]
NESTED_COLUMNS = ["economyimpact", "impact_matrix", "perception_lines", "tags"]
TRAINING_COLUMNS = ["id", "title", "introductory_paragraph", "tags"]

VECTOR_FIELDS = ["title", "description", "tags"]
VECTOR_COLUMNS = ["title_vec", "description_vec", "tags_vec"]

ARTICLE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ARTICLE_TEXT_COLUMNS]
    + [T.StructField("published_time_unix", T.LongType())]
)

ECONOMY_IMPACT = "struct<score:string, reason:string>"
PERCEPTION_LINES = "array<struct<tag:string, text:string>>"
IMPACT_MATRIX = (
    "array<struct<type:string, entity:array<struct<"
    "name:string, score:string, reason:string, perception_line:string>>>>"
)

LAKE_ARTICLE = (
    "id bigint, published_time timestamp, title string, introductory_paragraph string, "
    "descriptive_paragraph string, historical_context string, "
    "economyimpact struct<score:int, reason:string>, "
    f"impact_matrix {IMPACT_MATRIX}, perception_lines {PERCEPTION_LINES}, "
    "tags array<string>, ai_image_prompt string, processed_at string, published_time_unix bigint"
)

HOURLY_ARTICLE = (
    "struct<id:string, original_title:string, published_time:string, "
    "formatted_data:struct<title:string, descriptive_paragraph:string, "
    "tags:array<string>, economyImpact:struct<score:int>>, _corrupt_record:string>"
)
# Articles stay text until each is parsed by itself: one that is malformed costs no other.
HOURLY_FILE = "articles array<string>, _corrupt_record string"

VECTORS = T.StructType(
    [
        T.StructField("article_id", T.StringType()),
        T.StructField("point_id", T.LongType()),
        T.StructField("title_vec", T.ArrayType(T.FloatType())),
        T.StructField("description_vec", T.ArrayType(T.FloatType())),
        T.StructField("tags_vec", T.ArrayType(T.FloatType())),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("timestamp", T.LongType()),
        T.StructField("published_time", T.StringType()),
        T.StructField("economy_impact", T.IntegerType()),
    ]
)
