"""Places of rows inside their groups, in a given order, without gathering a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import Scratch

HELPERS = ["_row", "_part", "_at", "_local", "_lead"]


def numbered(scratch: Scratch, rows: DataFrame, name: str, group: list[str], order: list[str]) -> DataFrame:
    """The rows, written, with ``place``: 0, 1, 2 ... inside each group by ``order``.

    Rows are dealt by ranges of group, order and row number, so a group or a row that
    is repeated without end spreads over many tasks. A task numbers its own rows; only
    the first group of a range can have begun in an earlier one, so one number per
    range is what is missing, and one row per range is what the driver sees. Nulls of
    ``order`` come first; group columns hold no null. ``rows`` must be a written table,
    so that a task that runs again deals its rows as before.
    """
    keys = [*group, *order]
    dealt = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, starts, at = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c) for c in group]
            new = np.zeros(n, dtype=bool)
            for column in columns:
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = last != [c[0].as_py() for c in columns]
            index = np.arange(n)
            start = np.maximum.accumulate(np.where(new, index, -1))
            local = np.where(start >= 0, index - start, held + index)
            begun = starts + np.cumsum(new)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at + index),
                    pa.array(local), pa.array(begun == 1),
                ],
                [*batch.schema.names, *HELPERS[1:]],
            )
            last, held = [c[n - 1].as_py() for c in columns], int(local[-1]) + 1
            starts, at = int(begun[-1]), at + n

    schema = T.StructType([*dealt.schema.fields])
    for column, kind in zip(HELPERS[1:], ("integer", "long", "long", "boolean"), strict=True):
        schema = schema.add(column, kind)
    done = scratch.keep(dealt.mapInArrow(number, schema), f"{name}-placed")
    key = F.struct(*group)
    ends = done.groupBy("_part").agg(
        F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last"), F.max_by("_local", "_at").alias("local"),
    )
    carried, before, open_group = [], 0, None
    for end in sorted(ends.collect(), key=lambda r: r["_part"]):
        here = before if end["first"] == open_group else 0
        carried.append((end["_part"], here))
        open_group = end["last"]
        before = end["local"] + 1 + (here if end["first"] == end["last"] else 0)
    carry = scratch.spark.createDataFrame(carried, "_part int, _carry long")
    place = F.col("_local") + F.when(F.col("_lead"), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return done.join(F.broadcast(carry), "_part", "left").select(*rows.columns, place.alias("place"))
