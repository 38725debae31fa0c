"""Records that an outside service gives for batches of ids, with retries and resumption."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from weft.operators.relational import numbered
from weft.scratch import written


class Busy(Exception):
    """The service asks to come back after so many seconds."""

    def __init__(self, seconds: float = 2.0) -> None:
        super().__init__(f"busy for {seconds} s")
        self.seconds = seconds


def asked(fetch: Callable[[list[str]], dict[str, dict]], ids: list[str], tries: int, pause: float, wait: Callable[[float], None] = time.sleep) -> tuple[dict[str, dict], str | None]:
    """A batch's records by id, and what went wrong if the last of `tries` failed. Busy waits as long as it is told, other failures longer each time."""
    said = None
    for turn in range(tries):
        try:
            return fetch(ids), None
        except Busy as e:
            said, seconds = str(e), e.seconds
        except Exception as e:  # whatever the service does, the other batches go on
            said, seconds = f"{type(e).__name__}: {e}", pause * (turn + 1)
        if turn + 1 < tries:
            wait(seconds)
    return {}, said[:500]


def _ask(fetch: Callable, schema: pa.Schema, size: int, tries: int, pause: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[str] = []

    def rows(ids: list[str]) -> pa.RecordBatch:
        found, error = asked(fetch, ids, tries, pause)
        status = ["failed" if error else "found" if found.get(i) is not None else "absent" for i in ids]
        values = [[(found.get(i) or {}).get(f) for i in ids] for f in schema.names[1:-2]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *values, status, [error] * len(ids)], schema, strict=True)], schema=schema)

    for batch in batches:
        for i in batch.column(0).to_pylist():
            held.append(i)
            if len(held) == size:
                yield rows(held)
                held = []
    if held:
        yield rows(held)


def fetched(ids: DataFrame, fetch: Callable[[list[str]], dict[str, dict]], schema: str, size: int = 50, tasks: int = 4, tries: int = 5, pause: float = 2.0) -> DataFrame:
    """(id, the fields of schema, status, error) for each distinct id of the first column of `ids`; null ids aren't asked for.

    Ids stay in tasks, which ask in batches of `size`, one after the other: `tasks` bounds the requests at a time. status is found, absent (the
    answer has no record of the id) or failed (after `tries`); a failed batch doesn't stop the others.
    """
    spark = ids.sparkSession
    fields = spark.createDataFrame([], schema).schema.fields
    whole = StructType([StructField("id", StringType()), *fields, StructField("status", StringType()), StructField("error", StringType())])
    given = ids.select(F.col(f"`{ids.columns[0]}`").cast("string").alias("id")).filter("id is not null").distinct().repartition(tasks, "id")
    return given.mapInArrow(functools.partial(_ask, fetch, to_arrow_schema(whole), size, tries, pause), whole)


def landed(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier runs have written, null before the first."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    return spark.read.parquet(path) if there else None


def land(ids: DataFrame, fetch: Callable[[list[str]], dict[str, dict]], schema: str, path: str, order: list[Column] | None = None, portion: int = 10_000, **options) -> dict[str, int]:
    """Asks for what isn't in the table at `path` yet and appends it, `portion` ids at a time, those that come first in `order` first; numbers by status.

    Each portion is there once it is written, so a run that is stopped loses one at most, and the next asks only for ids that are
    missing or failed. The last row written for an id with status found or absent is the only one.
    """
    spark, counts = ids.sparkSession, {"found": 0, "absent": 0, "failed": 0}
    key = F.col(f"`{ids.columns[0]}`").cast("string")
    todo = ids.withColumn("_w_id", key).filter("_w_id is not null")
    if (done := landed(spark, path)) is not None:
        todo = todo.join(done.filter("status <> 'failed'").select(F.col("id").alias("_w_id")), "_w_id", "left_anti")
    todo = written(todo.withColumn("_w_n", F.row_number().over(Window.partitionBy("_w_id").orderBy(*(order or [F.lit(0)]))))).filter("_w_n = 1")
    placed = numbered(todo, [*(order or []), F.col("_w_id")], "_w_place").select("_w_id", "_w_place")
    placed = written(placed)
    total = placed.count()
    for start in range(0, total, portion):
        part = placed.filter(F.col("_w_place").between(start + 1, start + portion)).select("_w_id")
        rows = written(fetched(part, fetch, schema, **options))
        rows.filter("status <> 'failed'").drop("error").write.mode("append").parquet(path)
        for r in rows.groupBy("status").count().collect():
            counts[r["status"]] += r["count"]
    return counts

