"""Medians along the rows of wide matrices, in place."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Numbers of a batch that are looked at together.
CELLS = 1 << 22


def _medians(x: np.ndarray) -> np.ndarray:
    """Medians of the rows without their NaN."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # rows without numbers
        return np.nanmedian(x, axis=1)


def _differences(groups: list[tuple[str, list[int], list[int]]], threshold: float, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, CELLS // max(1, batch.num_columns))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            x = np.stack([c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in part.columns[1:]], 1)
            for name, case, control in groups:
                difference = _medians(x[:, case]) - _medians(x[:, control])
                kept = np.flatnonzero(np.abs(difference) >= threshold)
                data = [part.column(0).take(pa.array(kept)), [name] * len(kept), difference[kept], [len(case)] * len(kept), [len(control)] * len(kept)]
                yield pa.RecordBatch.from_arrays([d.cast(f.type) if isinstance(d, pa.Array) else pa.array(d, f.type) for d, f in zip(data, schema, strict=True)], schema=schema)


def median_differences(matrix: DataFrame, key: str, groups: dict[str, tuple[list[str], list[str]]], least: int, threshold: float) -> DataFrame:
    """(key, group, diff, n_case, n_control) of a matrix with a column for each sample: the median of a group's case columns less that of its control columns.

    Groups need `least` columns of both, differences a magnitude of `threshold`; nulls, NaN and cells that are no number have no part in a median.
    Each row is looked at where it lies: no shuffle, and no row for each cell. `groups` comes from the table of samples, whose
    size is that of the matrix's header.
    """
    groups = {g: (case, control) for g, (case, control) in groups.items() if min(len(case), len(control)) >= max(1, least)}
    columns = sorted({c for case, control in groups.values() for c in (*case, *control)})
    at = {c: i for i, c in enumerate(columns)}
    number = lambda c: F.col(f"`{c}`").try_cast("double") if matrix.schema[c].dataType.simpleString() == "string" else F.col(f"`{c}`").cast("double")
    kind = matrix.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("group", StringType()), StructField("diff", DoubleType()), StructField("n_case", LongType()), StructField("n_control", LongType())])
    plan = [(g, [at[c] for c in case], [at[c] for c in control]) for g, (case, control) in groups.items()]
    given = matrix.select(F.col(f"`{key}`"), *[number(c).alias(c) for c in columns])
    return given.mapInArrow(functools.partial(_differences, plan, threshold, to_arrow_schema(schema)), schema)


def sample_groups(samples: DataFrame, sample: str, group: str, is_case: str, is_control: str, columns: list[str]) -> dict[str, tuple[list[str], list[str]]]:
    """Case and control columns of each group, of the samples that the matrix has; a row for each column of the matrix's header at most goes to the driver."""
    there = set(columns)
    out: dict[str, tuple[list[str], list[str]]] = {}
    for r in samples.filter(F.col(group).isNotNull() & F.col(sample).isin(*columns)).select(F.col(sample).alias("s"), F.col(group).alias("g"), F.expr(is_case).alias("a"), F.expr(is_control).alias("b")).distinct().collect():
        case, control = out.setdefault(r["g"], ([], []))
        if r["s"] in there:
            if r["a"]:
                case.append(r["s"])
            if r["b"]:
                control.append(r["s"])
    return {g: (sorted(a), sorted(b)) for g, (a, b) in sorted(out.items())}
