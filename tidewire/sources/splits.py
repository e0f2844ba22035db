"""Records of text files that are read in splits, although a record may span lines.

A first pass counts, per split, what changes the state of the text: quotes, and for JSON
brackets outside of strings as well. Running sums over the splits of a file, one row
each, tell the state in which every split begins; the second pass cuts each split into
records from there, all splits side by side. A record that runs past its split comes in
pieces, at most two to a split, which are put together at the end; files without such
records, as any file of one split, have none and are not read for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.operators.skew import few

#: Rows of an Arrow batch that are Python objects at once.
UNPACKED_ROWS = 256
_CHUNK = ["file", "block"]
_RECORDS = "file string, block long, row long, text string, head boolean, open boolean"
_ESCAPED = re.compile(r"\\.", re.S)
_SIGN = re.compile(r'["\\\[\]{}]')

#: (text, whether the record began in an earlier split, whether it runs on into the next).
Piece = tuple[str, bool, bool]


def pieces_of(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(file, block, at, value): what lies between separators, in file order by ``at`` in a block."""
    return spark.read.option("lineSep", separator).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def csv_splits(pieces: DataFrame) -> DataFrame:
    """(file, block, first, inside, open): the first line of each split, and whether it begins and ends in quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    summed = pieces.groupBy(*_CHUNK).agg(F.sum(quotes).alias("quotes"), F.min_by("value", "at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("quotes").over(before), F.lit(0))
    return summed.select(*_CHUNK, "first", (so_far % 2 == 1).alias("inside"), ((so_far + F.col("quotes")) % 2 == 1).alias("open"))


def csv_cutter() -> Callable[[bool, int, Iterator[str]], Iterator[Piece]]:
    def cut(inside: bool, depth: int, lines: Iterator[str]) -> Iterator[Piece]:
        """Records end where a line ends outside of quotes."""
        held: list[str] = []
        head, odd = inside, inside
        for line in lines:
            held.append(line)
            odd ^= line.count('"') % 2 == 1
            if not odd:
                yield "\n".join(held), head, False
                held, head = [], False
        if held or head:
            yield "\n".join(held), head, True

    return cut


def json_splits(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """(file, block, first, inside, depth, open): whether a split begins in a string, how deep, and ends in a record.

    ``pieces`` are cut at opening braces. A split is summed up for both ways it can begin.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, values in _by_chunk(batches):
            quotes, outside, first = 0, [0, 0], None
            for value in values:
                piece = value if first is None and key[1] == 0 else "{" + value
                first = value if first is None else first
                parts = _ESCAPED.sub("", piece).split('"')
                for n, part in enumerate(parts):
                    outside[(quotes + n) % 2] += _deeper(part)
                quotes += len(parts) - 1
            columns = [[key[0]], [key[1]], [first], [quotes], [outside[0]], [outside[1]]]
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "block", "first", "quotes", "out", "in"]
            )

    found = pieces.select(*_CHUNK, "value").mapInArrow(summed, "file string, block long, first string, quotes long, out long, in long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = found.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    step = F.when(F.col("inside"), F.col("in")).otherwise(F.col("out"))
    deep = inside.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    ends_inside = F.col("inside") != (F.col("quotes") % 2 == 1)
    return deep.select(*_CHUNK, "first", "inside", "depth", (ends_inside | (F.col("depth") + F.col("step") > 1)).alias("open"))


def _deeper(part: str) -> int:
    return part.count("{") + part.count("[") - part.count("}") - part.count("]")


def json_cutter() -> Callable[[bool, int, Iterator[str]], Iterator[Piece]]:
    def cut(inside: bool, depth: int, values: Iterator[str]) -> Iterator[Piece]:
        """Elements of the outer list: objects, or whatever else stands between commas.

        A piece begins with an opening brace, but for the first of a file.
        """
        held: list[str] = []
        head = depth > 1 or inside
        for n, value in enumerate(values):
            # the first piece of a file is what stands before its first brace
            text = value if depth == 0 and n == 0 else "{" + value
            if not inside and depth == 1 and text[0] == "{":
                yield from _loose("".join(held), head)
                held, head = [], False
            start, at = 0, 0
            while m := _SIGN.search(text, at):
                sign, at = m[0], m.end()
                if sign == "\\":
                    at += inside
                elif sign == '"':
                    inside = not inside
                elif not inside:
                    depth += 1 if sign in "{[" else -1
                    if sign == "[" and depth == 1:
                        start = at
                    elif sign == "}" and depth == 1:
                        yield "".join([*held, text[start:at]]), head, False
                        held, head, start = [], False, at
                    elif sign == "]" and depth == 0:
                        held.append(text[start : at - 1])
                        start = at
            held.append(text[start:])
        rest = "".join(held)
        if depth > 1 or inside or head:
            yield rest, head, True
        else:
            yield from _loose(rest, head)

    return cut


def _loose(text: str, head: bool) -> Iterator[Piece]:
    """Elements that are no objects: not articles, but not to be lost."""
    text = text.strip(" \t\r\n,﻿")
    if text or head:
        yield text, head, False


def _by_chunk(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, block, more...), values) of each split, as its rows stream by."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, UNPACKED_ROWS):
                some = batch.slice(at, UNPACKED_ROWS)
                yield from zip(*(some.column(c).to_pylist() for c in (*_CHUNK, *more, "value")), strict=True)

    for key, group in groupby(rows(), key=lambda r: r[:-1]):
        yield key, (r[-1] for r in group)


def records(pieces: DataFrame, splits: DataFrame, n: int, cutter, separator: str) -> DataFrame:
    """(file, block, row, text) of every record; ``block`` and ``row`` are where it begins.

    ``splits`` is written, and has ``n`` rows; ``separator`` joins what a record has on
    both sides of a split.
    """
    if "depth" not in splits.columns:
        splits = splits.withColumn("depth", F.lit(0).cast("long"))
    broken = splits.where("open").select("file").distinct()
    state = few(splits.select(*_CHUNK, "inside", "depth"), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, values in _by_chunk(batches, ("inside", "depth")):
            out: list[tuple] = []
            size = 0
            for row, (text, head, open_) in enumerate(cutter(key[2], key[3], values)):
                out.append((*key[:2], row, text, head, open_))
                size += len(text)
                if len(out) >= 4096 or size > 1 << 22:
                    yield _record_batch(out)
                    out, size = [], 0
            if out:
                yield _record_batch(out)

    def cut(some: DataFrame) -> DataFrame:
        told = some.join(state, _CHUNK).select(*_CHUNK, "inside", "depth", "value")
        return told.mapInArrow(run, _RECORDS)

    whole = cut(pieces).where("not head and not open").select(*_CHUNK, "row", "text")
    if broken.isEmpty():
        return whole
    parts = cut(pieces.join(few(broken, n), "file", "left_semi")).where("head or open")
    order = Window.partitionBy("file").orderBy("block", "row")
    run_of = parts.withColumn("run", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order))
    joined = run_of.groupBy("file", "run").agg(F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("parts"))
    first = F.col("parts")[0]
    return whole.unionByName(
        joined.select("file", first["block"].alias("block"), first["row"].alias("row"), F.array_join(F.col("parts.text"), separator).alias("text"))
    )


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["file", "block", "row", "text", "head", "open"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
