"""Turns of sessions as a stream: each event gets its session's next number once, however often and late it comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session string, event string, at timestamp, content string, seq long"
#: What the state store of a query with arbitrary state must be.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Numbers(StatefulProcessor):
    """A session's next number, and the events that have one. Both go when no event has come for `idle_ms` of event time."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "n long")
        self.seen = handle.getMapState("seen", "event string", "seq long")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "event"], kind="stable")
        n = self.next.get()[0] if self.next.exists() else 0
        numbers, kept = [], []
        for place, event in enumerate(batch["event"]):
            if self.seen.containsKey((event,)):
                continue
            self.seen.updateValue((event,), (n,))
            kept.append(place)
            numbers.append(n)
            n += 1
        newest = int(batch["at"].max().timestamp() * 1000)
        before = self.last.get()[0] if self.last.exists() else -1
        if newest > before:
            if before >= 0:
                self.handle.deleteTimer(before + self.idle_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.idle_ms)
        self.next.update((n,))
        out = batch.iloc[kept][["event", "at", "content"]].assign(session=key[0], seq=numbers)
        yield out[["session", "event", "at", "content", "seq"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.next, self.seen, self.last):
            state.clear()
        yield pd.DataFrame({"session": [], "event": [], "at": pd.to_datetime([]), "content": [], "seq": []}).astype({"session": str, "event": str, "content": str, "seq": "int64"})

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, session: str, event: str, time: str, content: str, late: str = "1 hour", idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """(session, event, at, content, seq) of a stream of turns: numbers go on from 0 over all batches and runs, in the order of (time, event) within a batch.

    Events later than the watermark are dropped; a late one that isn't gets the next number and leaves others as they are; a repeated one
    gets none. Turns without content are ignored. A session that is silent for `idle_ms` of event time is forgotten and would begin anew. The query
    needs STORE in its session's settings.
    """
    given = stream.select(F.col(session).cast("string").alias("session"), F.col(event).cast("string").alias("event"), F.col(time).alias("at"), F.col(content).alias("content"))
    given = given.filter("session is not null and event is not null and at is not null and coalesce(content, '') <> ''").withWatermark("at", late)
    return given.groupBy("session").transformWithStateInPandas(Numbers(idle_ms), OUTPUT, "append", "eventTime")
