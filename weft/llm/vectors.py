"""What both vector operators share: usable vectors, classes of equal ones, cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Lengths with at most so many vectors are compared without an index.
FEW = 4096


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, d, v, h1, h2) of rows that take part: an id, and a vector of d doubles without nulls or non-finite numbers, not all zero. Vectors of different lengths have no cosine.

    h1 and h2 are a 128-bit hash of the vector.
    """
    given = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    given = given.filter("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    v = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    return given.select("id", F.size("v").alias("d"), v.alias("v")).select("id", "d", "v", *hashes(F.col("v")))


def hashes(v: Column) -> list[Column]:
    return [F.xxhash64(F.size(v), v).alias("h1"), F.xxhash64(F.lit(1), v, F.size(v)).alias("h2")]


def lengths(classes: DataFrame) -> dict[int, int]:
    """Vectors of each length d of `classes` that has more than FEW: at most their number / FEW lengths go to the driver."""
    return {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).orderBy("d").collect()}


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays of doubles as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines in double precision; vectors are scaled first, so that very long or short ones don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    y = y / np.abs(y).max(1, keepdims=True)
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
