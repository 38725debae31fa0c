"""Runs that execute, resume and count; components by alternating stars."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from weft.operators import paths
from weft.plans import pipeline
from weft.plans.pipeline import Step


def status(log):
    return {r.step: (r.status, dict(zip(r.tables, r.rows, strict=True))) for r in log.collect()}


def test_a_step_that_fails_while_it_runs(spark):
    """Nothing is computed before a step's tables are written: a division by zero belongs to its step."""
    steps = [
        Step("good", lambda s, t: {"a": s.range(7), "b": s.range(2)}),
        Step("bad", lambda s, t: {"c": t["a"].select(F.expr("1 / (id - id)").alias("x"))}, ("good",)),
        Step("needs_bad", lambda s, t: {"d": t["c"]}, ("bad",)),
        Step("needs_that", lambda s, t: {"e": t["d"]}, ("needs_bad",)),
        Step("other", lambda s, t: {"f": t["b"]}, ("good",)),
    ]
    tables, log = pipeline.run(spark, steps, {})
    assert status(log) == {"good": ("ok", {"a": 7, "b": 2}), "bad": ("failed", {}), "needs_bad": ("skipped", {}), "needs_that": ("skipped", {}), "other": ("ok", {"f": 2})}
    assert "c" not in tables and tables["f"].count() == 2
    said = {r.step: r.message for r in log.collect()}
    assert "DIVIDE_BY_ZERO" in said["bad"] and said["needs_that"] == "needs needs_bad"


def test_resumed_runs(spark, tmp_path):
    calls, broken = [], [True]

    def step(name, make, *needs, **more):
        def work(s, t):
            calls.append(name)
            return make(s, t)

        return Step(name, work, needs, **more)

    def fragile(s, t):
        return {"m": t["l"].withColumn("x", F.expr(f"1 / {0 if broken[0] else 1}"))}

    def steps(version="1"):
        return [step("load", lambda s, t: {"l": t["src"].filter("id > 2")}, reads=("src",)), step("side", lambda s, t: {"s": t["free"]}, reads=("free",)), step("middle", fragile, "load", reads=(), version=version), step("end", lambda s, t: {"e": t["m"].unionByName(t["m"])}, "middle", "side", reads=())]

    spark.range(10).write.parquet(f"{tmp_path}/src")
    spark.range(4).write.parquet(f"{tmp_path}/free")
    inputs = lambda: {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("src", "free")}
    run = lambda **more: pipeline.run(spark, steps(**more), inputs(), folder=f"{tmp_path}/out")
    _, log = run()
    assert {k: v[0] for k, v in status(log).items()} == {"load": "ok", "side": "ok", "middle": "failed", "end": "skipped"} and sorted(calls) == ["load", "middle", "side"]
    calls.clear()
    broken[0] = False
    tables, log = run()
    assert status(log) == {"load": ("reused", {"l": 7}), "side": ("reused", {"s": 4}), "middle": ("ok", {"m": 7}), "end": ("ok", {"e": 14})}
    assert sorted(calls) == ["end", "middle"] and tables["e"].count() == 14 and tables["l"].count() == 7
    calls.clear()
    assert {v[0] for v in status(run()[1]).values()} == {"reused"} and not calls
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/free")
    assert {k: v[0] for k, v in status(run()[1]).items()} == {"load": "reused", "side": "ok", "middle": "reused", "end": "ok"} and sorted(calls) == ["end", "side"]
    calls.clear()
    assert {k: v[0] for k, v in status(run(version="2")[1]).items()} == {"load": "reused", "side": "reused", "middle": "ok", "end": "ok"}
    last = {r.step: r.status for r in pipeline.last_runs(spark, f"{tmp_path}/out").collect()}
    assert last == {"load": "reused", "side": "reused", "middle": "ok", "end": "ok"}
    tables, log = pipeline.run(spark, steps(version="2"), inputs() | {"m": tables["m"], "s": tables["s"]}, start="end")
    assert status(log) == {"end": ("ok", {"e": 14})}


def test_steps_run_side_by_side(spark):
    meet = threading.Barrier(3, timeout=60)

    def waits(s, t):
        meet.wait()
        return {}

    _, log = pipeline.run(spark, [Step(str(i), waits) for i in range(3)], {}, workers=3)
    assert {v[0] for v in status(log).values()} == {"ok"}


def plain(keys, edges):
    label = {k: k for k in keys}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in edges:
        if a in label and b in label:
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {k: top(k) for k in keys}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    keys = [f"k{i:04d}" for i in range(600)]
    edges = [(rng.choice(keys), rng.choice(keys)) for _ in range(350)] + [(keys[i], keys[i + 1]) for i in range(300, 420)] + [("k0001", "nobody"), ("nobody", "k0002"), ("k0003", "k0003")]
    got = paths.connected_components(spark.createDataFrame([(k,) for k in [*keys, keys[0]]], "key string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {r.key: r.component for r in got.collect()} == plain(keys, edges) and got.count() == len(keys)
    assert paths.connected_components(spark.createDataFrame([], "key string"), spark.createDataFrame(edges, "src string, dst string")).count() == 0
    assert {r.component for r in paths.connected_components(spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([], "src string, dst string")).collect()} == {"a", "b"}


def test_a_large_star(spark):
    edges = spark.range(1, 300_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.createDataFrame([(300_001, 300_002), (17, 300_002)], "a long, b long"))
    assert paths.stars(edges).groupBy("component").count().collect() == [(0, 300_003)]
