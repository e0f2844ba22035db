"""Article sources."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.times import hourly_path
from tidewire.operators.increment import newer_than, oldest_first
from tidewire.operators.normalise import known_columns
from tidewire.operators.skew import few
from tidewire.schemas import (
    ARTICLE_COLUMNS,
    HOURLY_FILE,
    LAKE_ARTICLE,
    REQUIRED_COLUMNS,
    TRAINING_COLUMNS,
)
from tidewire.session import materialise
from tidewire.sources import splits

CORRUPT = "_corrupt_record"
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
}


def _with_order(df: DataFrame) -> DataFrame:
    """Source order: files by name, splits by offset, rows as they come."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return df.withColumn("_seq", place)


def headers(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for every header that occurs; empty files have none."""
    lines = splits.pieces_of(spark, path, "\n").where("block = 0")
    names, kinds = _kinds(lines.groupBy("file").agg(F.min_by("value", "at").alias("first")))
    found = kinds.groupBy("kind").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("kind").collect()
    return [(names[r["kind"]], [unquote(f) for f in r["files"]]) for r in found]


def _kinds(first: DataFrame) -> tuple[list[list[str]], DataFrame]:
    """The different headers, as column names, and (file, kind) of every file; only headers reach the driver."""
    lines = first.select("file", F.regexp_replace("first", "\r$", "").alias("line"))
    told = [r["line"] for r in lines.select("line").distinct().orderBy("line").collect()]
    names = [next(csv.reader([line.lstrip("\ufeff")]), []) for line in told]
    table = first.sparkSession.createDataFrame(list(zip(told, range(len(told)), strict=True)), "line string, kind int")
    return names, lines.join(F.broadcast(table), "line").select("file", "kind")


def check_columns(columns: list[str]) -> None:
    missing = [c for c in REQUIRED_COLUMNS if c not in [n.strip() for n in columns]]
    if missing:
        raise ValueError(f"required columns missing: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """All texts; only the empty field is null.

    Columns go by the names in each file's own header, in any order, and optional ones
    may be absent. Files are read in splits, with ``multi_line`` also those with line
    breaks in quotes; a feed without them saves a pass when it is off.
    """
    if not multi_line:
        found = headers(spark, path)
        for names, _ in found or [([], [])]:
            check_columns(names)
        return _by_files(spark, found)
    files = _CsvFiles(spark, path)
    for names in files.names or [[]]:
        check_columns(names)
    return files.rows(range(len(files.names)))


def _by_files(spark: SparkSession, found: list[tuple[list[str], list[str]]]) -> DataFrame:
    """Files without line breaks in quotes, by their headers."""
    frames = []
    for names, files in found:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
        frames.append(known_columns(_with_order(spark.read.options(**CSV_OPTIONS).schema(schema).csv(files))))
    return reduce(DataFrame.unionByName, frames)


class _CsvFiles:
    """CSV files with the state in which each of their splits begins, and their headers."""

    def __init__(self, spark: SparkSession, path: str | list[str]):
        self.lines = splits.pieces_of(spark, path, "\n")
        self.cut = materialise(splits.csv_splits(self.lines))
        self.n = self.cut.count()
        self.names, self.kinds = _kinds(self.cut.where("block = 0").select("file", "first"))

    def rows(self, wanted: Iterable[int]) -> DataFrame:
        """Articles of the files with these headers, each record parsed by its own."""
        kinds = few(self.kinds.where(F.col("kind").isin(*wanted)), self.n)  # a file has a split at least
        records = splits.records(self.lines, self.cut, self.n, splits.csv_cutter(), "\n").join(kinds, "file")
        text = F.regexp_replace("text", "\r$", "")
        # the header, the first record of a file, is no article
        rows = records.where("not (block = 0 and row = 0)").withColumn("text", text).where("text <> ''")
        options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
        parsed, told = rows, []
        for k in wanted:
            schema = ", ".join([*[f"c{i} string" for i in range(len(self.names[k]))], f"{CORRUPT} string"])
            parsed = parsed.withColumn(f"r{k}", F.when(F.col("kind") == k, F.from_csv("text", schema, options)))
            at = {name.strip(): i for i, name in enumerate(self.names[k])}
            own = [
                (F.col(f"r{k}.c{at[c]}") if c in at else F.lit(None).cast("string")).alias(c) for c in ARTICLE_COLUMNS
            ]
            told.append(F.when(F.col("kind") == k, F.struct(*own, F.col(f"r{k}.{CORRUPT}").alias(CORRUPT))))
        return parsed.select(F.coalesce(*told).alias("r"), F.struct("file", "block", "row").alias("_seq")).select("r.*", "_seq")


def read_dropped_csv(spark: SparkSession, files: list[str], multi_line: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """Rows of the files that have the required columns, and quarantine rows of the others."""
    schema = "id string, reason string, record string"
    if not multi_line:
        good, refused = [], []
        for names, some in headers(spark, files):
            reason = _refusal(names)
            refused += [(f, reason, ",".join(names)) for f in some if reason]
            good += [] if reason else [(names, some)]
        return _by_files(spark, good) if good else None, spark.createDataFrame(refused, schema)
    found = _CsvFiles(spark, files)
    reasons = [(k, _refusal(names), ",".join(names)) for k, names in enumerate(found.names)]
    good = [k for k, reason, _ in reasons if not reason]
    told = spark.createDataFrame([r for r in reasons if r[1]], "kind int, reason string, record string")
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("id")
    return found.rows(good) if good else None, found.kinds.join(F.broadcast(told), "kind").select(path, "reason", "record")


def _refusal(names: list[str]) -> str | None:
    try:
        check_columns(names)
    except ValueError as error:
        return str(error)
    return None


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that are one JSON list of articles each, in splits; list-valued tags become JSON text.

    An element that is no object, or is cut short, is a row with its text as corrupt record.
    """
    pieces = splits.pieces_of(spark, path, "{")
    cut = materialise(splits.json_splits(spark, pieces))
    # What comes before the first brace: blank for an object, a bracket for a list.
    if not cut.where("block = 0").where(~F.regexp_like("first", F.lit(r"^[\s\ufeff]*\["))).isEmpty():
        raise ValueError("a JSON source must be a list of articles")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*ARTICLE_COLUMNS, CORRUPT]])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = splits.records(pieces, cut, cut.count(), splits.json_cutter(), "").select(
        F.struct("file", "block", "row").alias("_seq"), "text", F.from_json("text", schema, options).alias("r")
    )
    odd = F.when(F.col("r").isNull() | ~F.startswith("text", F.lit("{")), F.col("text"))
    return known_columns(
        rows.select(*[F.col(f"r.{c}") for c in ARTICLE_COLUMNS], F.coalesce(f"r.{CORRUPT}", odd).alias(CORRUPT), "_seq")
    )


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Choose the reader by suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix == "json":
        return read_json(spark, path)
    raise ValueError(f"unsupported format .{suffix}; use .csv or .json")


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the source has no rows")
    return df


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAKE_ARTICLE).parquet(path).select(*ARTICLE_COLUMNS)


def all_articles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return oldest_first(read_lake(spark, path), limit)


def new_articles(
    spark: SparkSession, path: str, mark: int, limit: int | None = None, inclusive: bool = False
) -> DataFrame:
    return newer_than(read_lake(spark, path), mark, limit, inclusive)


def training_articles(articles: DataFrame) -> DataFrame:
    return articles.select(*TRAINING_COLUMNS)


def _below(spark: SparkSession, root: str) -> Column:
    """A file's path below the folder that is read: names repeat from day to day.

    Of a pattern the folder before its first sign counts.
    """
    root = re.sub(r"[^/]*[*?\[{].*$", "", root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = fs.makeQualified(path).toUri().getRawPath().rstrip("/") + "/"
    whole = F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    inside = F.substring(whole, F.lit(len(start) + 1), F.length(whole))
    return F.when(F.startswith(whole, F.lit(start)), inside).otherwise(whole)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("multiLine", "true").schema(HOURLY_FILE).json(path)
    return files.withColumn("file", _below(spark, path))


def hourly_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = (
        spark.readStream.option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .schema(HOURLY_FILE)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumn("file", _below(spark, path))


def hour_file(spark: SparkSession, root: str, at: datetime) -> str:
    """Path of the drop file of an instant, in the feed's zone."""
    row = spark.range(1).select(hourly_path(F.lit(at)).alias("p")).first()
    return f"{root.rstrip('/')}/{row['p']}"
