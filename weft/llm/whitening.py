"""Whitening of embeddings: exact sums and centred scatters of partitions, merged pairwise in a tree (Chan)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
#: Rows that are multiplied at once.
BLOCK = 4096


@dataclass(frozen=True)
class Moments:
    """Of n vectors: their sums (Python integers or floats, so that integers stay exact) and the scatter around their mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        """Chan's pairwise formula; the difference of means is taken before anything is rounded."""
        if not self.n or not other.n:
            return self if self.n else other
        delta = ((other.sums * self.n - self.sums * other.n) / (self.n * other.n)).astype(float)
        weight = self.n * other.n / (self.n + other.n)
        return Moments(self.n + other.n, self.sums + other.sums, self.scatter + other.scatter + np.outer(delta * weight, delta))


def moments(x: np.ndarray) -> Moments:
    """Moments of the rows of x, integers or floats, centred before they are multiplied."""
    sums = x.sum(0).astype(object)
    z = _centred(x, len(x), sums)
    return Moments(len(x), sums, z.T @ z)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean sums / n. Integers: (n * x - sums) / n, rounded once."""
    if x.dtype.kind == "f":
        return x - (sums / n).astype(float)
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([int(s) % n / n for s in sums])
    return (x - whole).astype(float) - rest


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of each length in a column, as the places of their rows and a matrix of x = floor(64 * c) + 1000000, within +-2**50."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        for a in range(0, len(rows), BLOCK):
            c = column.take(pa.array(rows[a : a + BLOCK])).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield rows[a : a + BLOCK], np.clip(np.floor(c.astype(float) * SCALE), -(2.0**50), 2.0**50).astype(np.int64) + SHIFT


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's count, sums and centred scatter, a row for each length of vectors."""
    held: dict[int, Moments] = {}
    for batch in batches:
        for _, x in by_length(batch.column("v")):
            own = moments(x)
            held[x.shape[1]] = held[x.shape[1]].merge(own) if x.shape[1] in held else own
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.n for m in held.values()]), pa.array([[str(s) for s in m.sums] for m in held.values()], pa.list_(pa.string())), pa.array([m.scatter.tobytes() for m in held.values()], pa.binary())], ["n", "sums", "scatter"]
        )


def _check(models: dict[int, Model], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _local, of whitened vectors."""
    held: dict[int, Moments] = {}
    for batch in batches:
        for _, x in by_length(batch.column("v")):
            own = moments(models[x.shape[1]].whiten(x))
            held[x.shape[1]] = held[x.shape[1]].merge(own) if x.shape[1] in held else own
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held)), pa.array([m.n for m in held.values()]), pa.array([m.sums.astype(float).tobytes() for m in held.values()], pa.binary()), pa.array([m.scatter.tobytes() for m in held.values()], pa.binary())], ["d", "n", "sums", "scatter"]
        )


def _merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {d: a[d].merge(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def _square(row) -> np.ndarray:
    flat = np.frombuffer(row["scatter"])
    d = int(round(len(flat) ** 0.5))
    return flat.reshape(d, d)


def _integers(row) -> dict[int, Moments]:
    sums = np.array([int(s) for s in row["sums"]], object)
    return {len(sums): Moments(row["n"], sums, _square(row))}


def _floats(row) -> dict[int, Moments]:
    return {row["d"]: Moments(row["n"], np.frombuffer(row["sums"]).astype(object), _square(row))}


def _tree(stats: DataFrame, read: Callable) -> dict[int, Moments]:
    """All partitions' moments, merged pairwise on the executors; the driver gets one of each length."""
    found = stats.rdd.mapPartitions(lambda rows: [functools.reduce(_merged, map(read, rows), {})])
    return found.treeReduce(_merged) if found.getNumPartitions() else {}


@dataclass(frozen=True)
class Model:
    """The first components of vectors of one length: exact sums, unit eigenvectors as columns by falling eigenvalue, eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; 0 where there is no variance."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), 0.0)
        return _centred(x, self.n, self.sums) @ (self.vectors * scale)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over the dimensions of (n * x - sums)^2 in whole numbers; null where that doesn't fit in 64 bits."""
        n, d = self.n, len(self.sums)
        whole = np.array([int(s) // n for s in self.sums], object)
        rest = self.sums - whole * n
        z = x - whole.astype(np.int64)
        if float(n) * float(np.abs(z).max(initial=0) + 1) < (2**62 / d) ** 0.5:
            y = z * n - rest.astype(np.int64)
            return pa.array((y * y).sum(1))
        exact = [sum((int(a) * n - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in z]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def _model(m: Moments, components: int) -> Model:
    """eigh of the covariance. Values that are 0 in double precision count as 0; a component's largest entry is positive, so that reruns agree."""
    cov = (m.scatter + m.scatter.T) / (2 * m.n)
    values, vectors = np.linalg.eigh(cov)
    trace = float(np.trace(cov))
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values > 16 * len(values) * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    k = min(components, len(values))
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(0), np.arange(k)])
    return Model(m.n, m.sums, vectors, values[:k], trace)


def _project(models: dict[int, Model], errors: dict[int, float | None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id")
        for rows, x in by_length(batch.column("v")):
            m = models[x.shape[1]]
            k, r = len(m.values), len(rows)
            white, none = m.whiten(x).ravel(), np.tile(m.values <= 0, r)
            each = pa.array(np.repeat(np.arange(r), k))
            share = np.tile(m.values / m.trace if m.trace > 0 else m.values, r)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                    pa.array(np.full(r * k, m.n, np.int64)),
                    m.deviations(x).take(each),
                    pa.array(white, mask=none),
                    pa.array(share, mask=np.full(r * k, m.trace <= 0)),
                    pa.array([errors[x.shape[1]]] * (r * k), pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def fit(vectors: DataFrame, components: int = 32) -> dict[int, Model]:
    """Models of the vectors (v array<double>) by their length."""
    return {d: _model(m, components) for d, m in _tree(vectors.select("v").mapInArrow(_local, "n long, sums array<string>, scatter binary"), _integers).items()}


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float | None]:
    """A second pass: how far the covariance of the whitened vectors is from the identity, at most, by length; null if nothing varies."""
    stats = vectors.select("v").mapInArrow(functools.partial(_check, models), "d long, n long, sums binary, scatter binary")
    out: dict[int, float | None] = {}
    for d, m in _tree(stats, _floats).items():
        used = models[d].values > 0
        out[d] = float(np.abs(m.scatter / m.n - np.eye(len(used)))[np.ix_(used, used)].max()) if used.any() else None
    return out


def whiten(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to `components`.

    Vectors that are null or hold null or non-finite entries are left out; all others are fitted and returned, repeated
    rows and null ids each for themselves. Vectors of each length are whitened on their own (n is their number), empty
    ones have no component. Entries beyond 2**44 count as that. A component without variance (equal vectors, fewer vectors than
    dimensions) has whitened null and explained 0 (null if nothing varies); identity_error is over the others. deviation is null where it doesn't fit
    in a long. No vectors give no rows. A partition sends d sums and d * d products for each length to the tree, the driver
    gets one such set of each length.
    """
    given = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    given = given.filter("v is not null and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    models = fit(given, components)
    kind = table.schema[id_column].dataType.simpleString()
    rows = given.mapInArrow(functools.partial(_project, models, identity_errors(given, models)), f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return rows.withColumnRenamed("id", id_column)
