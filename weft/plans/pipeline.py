"""Ingestion as a graph of steps: each writes its tables when what it needs succeeded, failures poison what depends on them, all runs are logged and resumed."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weft.scratch import folder as scratch_folder

RUNS = "step string, status string, message string, fingerprint string, path string, tables array<string>, rows array<long>, seconds double, ran_at timestamp"


@dataclass(frozen=True)
class Step:
    """A named step: from the tables there are it makes new ones. version: to be raised when what it does changes; reads: the inputs that it reads, all if None."""

    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], dict[str, DataFrame]]
    needs: tuple[str, ...] = ()
    version: str = "1"
    reads: tuple[str, ...] | None = None


@dataclass
class _State:
    tables: dict[str, DataFrame]
    status: dict[str, str] = field(default_factory=dict)
    prints: dict[str, str] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)


def ordered(steps: list[Step]) -> list[Step]:
    """Steps after those they need, otherwise as given."""
    left, done, out = list(steps), set(), []
    while left:
        ready = next((s for s in left if all(n in done for n in s.needs)), None)
        if ready is None:
            raise ValueError(f"steps need each other or unknown ones: {[s.name for s in left]}")
        left.remove(ready)
        done.add(ready.name)
        out.append(ready)
    return out


def fingerprint(spark: SparkSession, df: DataFrame) -> str:
    """Tells whether a table is what it was: by its columns, its plan, and names, sizes and times of its files."""
    files = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append((name, status.getLen(), status.getModificationTime()))
    shape = df._jdf.queryExecution().analyzed().canonicalized().toString() if not files else str(df.dtypes)
    return hashlib.sha256(repr((df.dtypes, files, shape)).encode()).hexdigest()


def write(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Writes the tables under `path`; their numbers of rows, counted in the same passes."""
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def last_runs(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last logged run of each step in `folder`, null before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_runs")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(RUNS).parquet(f"{folder}/_runs").groupBy("step").agg(F.max_by(F.struct("*"), "ran_at").alias("r")).select("r.*")


def run(spark: SparkSession, steps: list[Step], inputs: dict[str, DataFrame], start: str | None = None, folder: str | None = None, workers: int = 4) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables, and the log (step, status, message, tables, rows, ...) of this run.

    A step's tables are written while it runs, under a name of their own; the row in the log is what makes them count, so a step that fails half-way
    leaves nothing behind that is read. Up to `workers` steps run side by side when nothing binds them. A failed step's dependants
    are skipped. With a `folder`, a step whose inputs, version and needs are what they were in its last successful run isn't run again (status reused),
    so a second run starts at what failed or changed. `start` leaves out the steps before it (their tables must be among the inputs).
    """
    base = folder or scratch_folder(spark)
    todo = ordered(steps)
    todo = todo[[s.name for s in todo].index(start) :] if start else todo
    chosen = {s.name for s in todo}
    old = {r["step"]: r for r in (last_runs(spark, base).collect() if folder and last_runs(spark, base) is not None else [])}
    state, lock = _State(dict(inputs)), threading.Lock()
    given = {name: fingerprint(spark, df) for name, df in inputs.items()} if folder else {}

    def log(row: tuple) -> None:
        with lock:
            state.rows.append(row)
            if folder:
                spark.createDataFrame([row], RUNS.replace(", ran_at timestamp", "")).withColumn("ran_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{base}/_runs")

    def one(step: Step) -> None:
        begun, path = time.time(), f"{base}/{step.name}/{uuid.uuid4().hex}"
        with lock:
            tables = dict(state.tables)
            read = step.reads if step.reads is not None else tuple(sorted(given))
            mark = hashlib.sha256(repr((step.name, step.version, [(n, state.prints.get(n)) for n in step.needs], [(n, given.get(n)) for n in read])).encode()).hexdigest()
        before = old.get(step.name)
        if before and before["status"] in ("ok", "reused") and before["fingerprint"] == mark:
            made, row = list(before["tables"]), (step.name, "reused", "", mark, before["path"], before["tables"], before["rows"], time.time() - begun)
            path = before["path"]
        else:
            try:
                counts = write(step.run(spark, tables), path)
                made, row = list(counts), (step.name, "ok", "", mark, path, list(counts), list(counts.values()), time.time() - begun)
            except Exception as e:  # a step's failure is a result of the run
                made, row = [], (step.name, "failed", f"{type(e).__name__}: {e}"[:500], mark, path, [], [], time.time() - begun)
        log(row)
        with lock:
            state.status[step.name], state.prints[step.name] = row[1], mark
            for name in made:
                state.tables[name] = spark.read.parquet(f"{path}/{name}")

    waiting, running = list(todo), {}
    with ThreadPoolExecutor(workers) as pool:
        while waiting or running:
            for step in list(waiting):
                bad = [n for n in step.needs if state.status.get(n) in ("failed", "skipped")]
                if bad:
                    waiting.remove(step)
                    state.status[step.name] = "skipped"
                    log((step.name, "skipped", f"needs {', '.join(bad)}", "", "", [], [], 0.0))
                elif len(running) < workers and all(state.status.get(n) in ("ok", "reused") for n in step.needs if n in chosen):
                    waiting.remove(step)
                    running[pool.submit(inheritable_thread_target(spark)(one), step)] = step
            if running:
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for f in done:
                    del running[f]
                    f.result()
    position = {s.name: i for i, s in enumerate(todo)}
    rows = sorted(state.rows, key=lambda r: position[r[0]])
    return state.tables, spark.createDataFrame(rows, RUNS.replace(", ran_at timestamp", ""))

