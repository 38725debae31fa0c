"""Turns and days as streams, over several bounded runs."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from weft.operators import conversations, literature
from weft.sources import days
from weft.streaming import events, turns


@pytest.fixture
def store(spark):
    before = spark.conf.get(turns.STORE[0])
    spark.conf.set(*turns.STORE)
    yield
    spark.conf.set(turns.STORE[0], before)


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


SCHEMA = "s string, e string, t timestamp, c string"


def run(spark, folder, rows, **options):
    """One bounded run over what has come so far; returns the new rows."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = []
    stream = turns.numbered(events.read(spark, f"{folder}/in", SCHEMA, 100), "s", "e", "t", "c", **options)
    events.run_available(stream, lambda b, i: out.extend(b.collect()), f"{folder}/c")
    return sorted((r.session, r.event, r.seq) for r in out)


def test_turns_go_on_over_runs(spark, tmp_path, store):
    folder = str(tmp_path)
    assert run(spark, folder, [("a", "a2", at(2), "x"), ("a", "a1", at(1), "x"), ("b", "b1", at(1), "x"), ("a", "blank", at(1), ""), ("a", "none", at(1), None), (None, "n", at(1), "x")]) == [("a", "a1", 0), ("a", "a2", 1), ("b", "b1", 0)]
    again = [("a", "a1", at(1), "x"), ("a", "a3", at(3), "x"), ("a", "late", at(0), "x"), ("a", "a3", at(3), "x"), ("c", "c1", at(3), "x")]
    assert run(spark, folder, again) == [("a", "a3", 3), ("a", "late", 2), ("c", "c1", 0)]
    assert run(spark, folder, [("a", "a4", at(4), "x"), ("b", "b1", at(1), "x")]) == [("a", "a4", 4)]


def test_silent_sessions_are_forgotten(spark, tmp_path, store):
    folder, options = str(tmp_path), {"late": "1 minute", "idle_ms": 10 * 60_000}
    assert run(spark, folder, [("a", "a1", at(0), "x"), ("b", "b1", at(0), "x")], **options) == [("a", "a1", 0), ("b", "b1", 0)]
    assert run(spark, folder, [("b", "b2", at(8), "x")], **options) == [("b", "b2", 1)]
    run(spark, folder, [("z", "z1", at(15), "x")], **options)
    assert run(spark, folder, [("a", "a2", at(16), "x"), ("b", "b3", at(16), "x")], **options) == [("a", "a2", 0), ("b", "b3", 2)]


def test_saved_turns(spark):
    schema = "session_id string, seq long, role string, content string"
    old = spark.createDataFrame([("a", 0, "user", "x"), ("a", 4, "assistant", "y"), ("n", None, "user", "z")], schema)
    new = spark.createDataFrame([("a", "t2", "user", "later"), ("a", "t1", "user", "sooner"), ("a", "t0", "user", ""), ("a", "t0", "user", None), ("b", "t1", "user", "first"), ("n", "t1", "user", "q"), (None, "t1", "user", "q")], "session_id string, ts string, role string, content string")
    got = conversations.save(old, new, ["ts"])
    assert got.columns == old.columns and sorted((r.session_id, r.seq, r.content) for r in got.collect()) == [("a", 5, "sooner"), ("a", 6, "later"), ("b", 0, "first"), ("n", 0, "q")]
    assert sorted((r.session_id, r.seq) for r in conversations.load(old.union(got), 2).filter("session_id = 'a'").collect()) == [("a", 0), ("a", 4)]


def test_days_are_offsets(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(day):
        with open(os.path.join(folder, "asked"), "a") as f:
            f.write(day + "\n")
        return [(f"{day}-{k}", datetime.date.fromisoformat(day)) for k in range(int(day[-2:]) % 3)]

    def read(until):
        out = []
        stream = days.stream(spark, "weft_test_days", fetch, "pmid string, day date", "2024-01-01", until)
        events.run_available(stream, lambda b, i: out.extend(literature.recent(b, "day", F.lit(until), 30).collect()), f"{folder}/c")
        return sorted(r.pmid for r in out)

    assert read("2024-01-04") == ["2024-01-01-0", "2024-01-02-0", "2024-01-02-1", "2024-01-04-0"]
    assert read("2024-01-04") == []
    assert read("2024-01-06") == ["2024-01-05-0", "2024-01-05-1"]
    assert sorted(set(open(os.path.join(folder, "asked")).read().split())) == [f"2024-01-0{d}" for d in range(1, 7)]
    assert len(open(os.path.join(folder, "asked")).read().split()) == 6
