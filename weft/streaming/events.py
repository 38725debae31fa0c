"""Structured Streaming: windows with watermarks, deduplication, per-session turns, and bounded incremental runs. An extension: the batch agents this engine follows have no event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the lateness bound, which bounds the state."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def _bounded(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark, unless the stream has one already (late is None then)."""
    return events.withWatermark(time, late) if late else events


def tumbling(events: DataFrame, time: str, late: str | None, width: str, by: str, slide: str | None = None) -> DataFrame:
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return _bounded(events, time, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, late: str | None, gap: str, by: str) -> DataFrame:
    return _bounded(events, time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """One bounded incremental run: all that is there since the last one, in micro-batches, then the end."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()


def last_write(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of a micro-batch, ready for an idempotent upsert."""
    columns = [c for c in batch.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns])
