"""Helpers that several operators share: vectorised word hashing, grouped streaming, components."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.scratch import written

#: Java pattern of a word: whatever is between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Key sets up to this size are broadcast to a semi-join, larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def _few(keys: DataFrame) -> DataFrame:
    """keys, marked for a broadcast if their counted size allows it."""
    return F.broadcast(keys) if keys.count() * 32 <= BROADCAST_BYTES else keys


def having(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of df whose `columns` are in keys (written longs); wide rows aren't shuffled while the keys are few."""
    return df.join(_few(keys), list(columns), "left_semi")


def lacking(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of df whose `columns` aren't in keys; otherwise as `having`."""
    return df.join(_few(keys), list(columns), "left_anti")


def row_key(id_column: Column, text: Column) -> list[Column]:
    """k1 and k2: 128 bits that tell rows apart by id and text; a null text counts as an empty one."""
    shown = F.coalesce(id_column.cast("string"), F.lit("\0"))
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(shown, text).alias("k1"), F.xxhash64(F.lit(7), text, shown).alias("k2")]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (a, b): (node, component), component the smallest reachable node.

    Alternating large-star and small-star steps, each a grouped minimum and a join, until the edges no longer change. Minima
    of the large step are written before they are joined, so that Spark may split a hub's edges.
    Nodes without an edge (or only with themselves) aren't returned.
    """
    a, b = edges.columns
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct().toDF("node", "component"))


# Word hashing ------------------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the five words of a shingle.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    random = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(65, 91):  # A-Z count as a-z
        random[i] = random[i + 32]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return random, space


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts, one after the other, and each text's first word (n + 1 places)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    random, space = _byte_tables()
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(1 << max(20, int(len(data) - 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(random[data] * up[: len(data)], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words in order; of the whole sequence if there are fewer, of none if there are none."""
    n = len(words)
    if n == 0:
        return words
    places = np.resize(_PLACE, width)
    if n < width:
        return mix(np.array([np.sum(words * places[:n]) + np.uint64(n)], np.uint64))
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out += words[i : n - width + 1 + i] * places[i]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices with about `limit` bytes of `column` each, one row at least: long texts don't pile up in memory."""
    i = batch.schema.get_field_index(column)
    lengths = pc.binary_length(batch.column(i)).fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(lengths)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls `work` for each run of rows with equal integer keys in sorted batches; a run may stretch over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held:
            before = held[-1].slice(held[-1].num_rows - 1, 1)
            if any(before.column(before.schema.get_field_index(k))[0].as_py() != c[0].item() for k, c in zip(keys, columns, strict=True)):
                yield from work(pa.Table.from_batches(held))
                held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield from work(pa.Table.from_batches(held))
                held = []
    if held:
        yield from work(pa.Table.from_batches(held))
