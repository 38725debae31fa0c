"""Line numbers of files that are read in splits."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A split's first number plus the row's place in it. Rows of a split follow each other, splits with rows have different first numbers."""
    last, seen = -1, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        start = batch.column("_w_start").to_numpy()
        begins = np.ones(n, bool)
        begins[1:] = start[1:] != start[:-1]
        run = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        place = np.arange(n) - run
        if start[0] == last:
            place[run == 0] += seen
        last, seen = start[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(start + place)], [*batch.schema.names[:-1], "_w_idx"])


def numbered(read: DataFrame, columns: list | None = None, out: str = "idx") -> DataFrame:
    """`columns` of what a file reader reads, and `out`: the row's place in the file, from 0; several files follow each other by path.

    Two passes: one counts the rows of each split, whose sums are a row for each split and go to every task; the other
    numbers rows where they are read. Text isn't shuffled, and how files are split doesn't change a number.
    """
    split = [F.col("_metadata.file_path").alias("_w_file"), F.col("_metadata.file_block_start").alias("_w_block")]
    origin = read.select(*(columns or read.columns), *split)
    sizes = read.select(*split).groupBy("_w_file", "_w_block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("_w_file", "_w_block", (F.sum("n").over(Window.orderBy("_w_file", "_w_block")) - F.col("n")).alias("_w_start"))
    met = origin.join(F.broadcast(starts), ["_w_file", "_w_block"], "left").drop("_w_file", "_w_block")
    met = met.withColumn("_w_start", F.coalesce("_w_start", F.raise_error(F.lit("files were split otherwise than when their lines were counted")).cast("long")))
    schema = StructType([*met.schema.fields[:-1], StructField("_w_idx", LongType())])
    return met.mapInArrow(_number, schema).withColumnRenamed("_w_idx", out)
