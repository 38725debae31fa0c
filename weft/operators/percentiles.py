"""Exact percentiles of many columns at once, in a fixed number of passes."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.scratch import written

#: Bits of a number that each pass settles, 64 in all: sign, exponent and ten bits of the fraction first.
PASSES = (22, 21, 21)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit patterns of doubles, which are in order as the numbers are; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(float)[0])


@dataclass(frozen=True)
class Goal:
    """A wanted value: its column, the leading bits that are settled, and its place among the values that share them."""

    column: int
    prefix: int
    place: int


def _counts(goals: tuple[Goal, ...] | None, width: int, settled: int, next_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's values have which next bits behind each settled prefix, (column, prefix, bits, n)."""
    held: dict[tuple[int, int], dict[int, int]] = {}
    wanted = sorted({(g.column, g.prefix) for g in goals}) if goals else [(i, 0) for i in range(width)]
    for batch in batches:
        columns = {}
        for column, prefix in wanted:
            if column not in columns:
                x = batch.column(column).drop_null().to_numpy(zero_copy_only=False)
                columns[column] = ordered_bits(x[~np.isnan(x)])
            bits = columns[column]
            if settled:
                bits = bits[bits >> np.uint64(64 - settled) == np.uint64(prefix)]
            found, n = np.unique((bits >> np.uint64(64 - settled - next_bits)) & np.uint64((1 << next_bits) - 1), return_counts=True)
            own = held.setdefault((column, prefix), {})
            for b, k in zip(found.tolist(), n.tolist(), strict=True):
                own[b] = own.get(b, 0) + k
    rows = [(c, p, b, n) for (c, p), own in held.items() for b, n in own.items()]
    if rows:
        c, p, b, n = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(p, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["column", "prefix", "bits", "n"])


def percentiles(df: DataFrame, columns: list[str], share: float, missing: float | None = None) -> dict[str, float | None]:
    """The exact percentile (linear between two order statistics) of each column, null for one without values.

    Nulls and NaN don't count, or count as `missing` if that is given. Four jobs whatever the columns and the values: one writes them as numbers, three
    settle 22, 21 and 21 bits of all order statistics, with counts that tasks sum up first; the driver gets two rows a column from each.
    """
    value = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(missing).cast("double")), F.lit(missing).cast("double"))
    values = written(df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    goals: tuple[Goal, ...] | None = None
    parts: dict[int, float] = {}
    settled = 0
    for width in PASSES:
        counts = values.mapInArrow(functools.partial(_counts, goals, len(columns), settled, width), "column long, prefix long, bits long, n long").groupBy("column", "prefix", "bits").agg(F.sum("n").alias("n"))
        own = Window.partitionBy("column", "prefix")
        ranked = counts.withColumn("end", F.sum("n").over(own.orderBy("bits"))).withColumn("total", F.sum("n").over(own))
        if goals is None:
            place = (F.col("total") - 1) * F.lit(float(share))
            first = F.floor(place)
            wanted = ranked.withColumn("place", F.explode(F.array(first, F.least(first + 1, F.col("total") - 1)))).withColumn("part", place - first)
        else:
            asked = df.sparkSession.createDataFrame([(g.column, g.prefix, g.place) for g in dict.fromkeys(goals)], "column long, prefix long, place long")
            wanted = ranked.join(F.broadcast(asked), ["column", "prefix"]).withColumn("part", F.lit(0.0))
        hit = wanted.filter((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n")))
        found = {(r["column"], r["prefix"], r["place"]): r for r in hit.collect()}
        if goals is None:
            parts = {r["column"]: r["part"] for r in found.values()}
            keys = [k for c in range(len(columns)) for k in sorted(k for k in found if k[0] == c) for _ in range(1 if sum(x[0] == c for x in found) == 2 else 2)]
        else:
            keys = [(g.column, g.prefix, g.place) for g in goals]
        goals = tuple(Goal(k[0], k[1] << width | r["bits"], k[2] - r["end"] + r["n"]) for k in keys for r in [found[k]])
        settled += width
        if not goals:
            break
    out: dict[str, float | None] = dict.fromkeys(columns)
    for low, high in zip(goals[::2], goals[1::2], strict=True):
        a, b = from_bits(low.prefix & ((1 << 64) - 1)), from_bits(high.prefix & ((1 << 64) - 1))
        out[columns[low.column]] = a if a == b else a + (b - a) * parts[low.column]
    return out


def clipped(df: DataFrame, columns: dict[str, str], share: float, missing: float | None = None) -> DataFrame:
    """df with each column over its percentile, between 0 and 1, under the name that it maps to; 0 for missing values and where the percentile isn't above 0."""
    bounds = percentiles(df, list(columns), share, missing)
    for column, out in columns.items():
        bound = bounds[column]
        value = F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))
        weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / F.lit(bound))) if bound is not None and bound > 0 else F.lit(0.0)
        df = df.withColumn(out, F.when(value.isNull(), F.lit(0.0)).otherwise(weight))
    return df
