"""Records by date as a stream whose offsets are days."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


@dataclass
class Day(InputPartition):
    day: str


class _Days(DataSourceStreamReader):
    """An offset is the next day to read; `until` is the last one that is complete."""

    def __init__(self, fetch: Callable[[str], Iterable[tuple]], first: str, until: str) -> None:
        self.fetch, self.first, self.until = fetch, date.fromisoformat(first), date.fromisoformat(until)

    def initialOffset(self) -> dict:
        return {"day": self.first.isoformat()}

    def latestOffset(self) -> dict:
        return {"day": max(self.first, self.until + timedelta(days=1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = date.fromisoformat(start["day"]), date.fromisoformat(end["day"])
        return [Day((a + timedelta(days=k)).isoformat()) for k in range((b - a).days)]

    def read(self, partition: Day) -> Iterator[tuple]:
        yield from self.fetch(partition.day)

    def commit(self, end: dict) -> None:
        pass


def stream(spark: SparkSession, name: str, fetch: Callable[[str], Iterable[tuple]], columns: str, first: str, until: str) -> DataFrame:
    """What `fetch` gives for each day from `first` to `until` (ISO dates), a task for each day. A query's checkpoint holds the next day, so a later run
    with a later `until` reads only the days since; a batch that failed is read again whole, so sinks should be idempotent."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Days(fetch, self.options["first"], self.options["until"])

    spark.dataSource.register(Source)
    return spark.readStream.format(name).options(first=first, until=until).load()
