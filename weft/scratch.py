"""Tables in the folder that driver and executors share, to cut lineage between rounds."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(1)
def _own() -> str:
    return tempfile.mkdtemp(prefix="weft-")


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; on a local master that setting may be missing, a temporary folder then stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own()
    return f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table: a lost executor costs no recomputation, and a loop's plan doesn't grow."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, column: str, dealt: bool = False) -> DataFrame:
    """`df` as a table of `n` buckets by `column`, in the same folder: groupings and joins of such tables by that column need no shuffle.
    dealt: rows of a key lie in one task already, so they are written where they are."""
    name = f"weft_{uuid.uuid4().hex}"
    given = df if dealt else df.repartition(n, column)
    given.write.format("parquet").option("compression", "zstd").option("path", folder(df.sparkSession)).bucketBy(n, column).saveAsTable(name)
    return df.sparkSession.table(name)
