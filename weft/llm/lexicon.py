"""Chunks of documents as codes into their own vocabulary: strings are shuffled once for each chunk that has them, not for each occurrence."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import slices

#: Bytes of text in a chunk; one document at least.
CHUNK_BYTES = 16 << 20


@functools.lru_cache(4)
def separators(solid: bytes) -> np.ndarray:
    """Which bytes lie between words: all ASCII that isn't in `solid`; bytes of other characters are parts of words."""
    out = np.ones(256, bool)
    out[128:] = False
    out[list(solid)] = False
    return out


@functools.lru_cache(1)
def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def words(texts: pa.Array, solid: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, one after the other, and each text's first word (n + 1 places); a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _lower()[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~separators(solid)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    kept = data[inside]
    places = np.append(np.cumsum(inside)[starts] - 1, len(kept)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.tobytes()), pa.py_buffer(kept.tobytes())), np.searchsorted(starts, offsets)


def encode(arrays: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Codes of all strings, and the distinct ones in the order of their codes."""
    whole = pa.chunked_array(arrays, pa.large_string()).dictionary_encode()
    if not whole.num_chunks:
        return np.zeros(0, np.int32), pa.array([], pa.large_string())
    return np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks]), whole.chunk(whole.num_chunks - 1).dictionary


def chunks(read: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], text: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray, pa.Array]]:
    """A task's documents in chunks: a number that no other chunk has, the documents without their text, each one's first code (n + 1 places), codes, vocabulary."""
    task, number = TaskContext.get().partitionId() << 32, 0
    held: list = []
    size = 0

    def out():
        rest = pa.Table.from_batches([h[0] for h in held])
        counts = np.concatenate([np.diff(h[2]) for h in held])
        return task + number, rest, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), *encode([h[1] for h in held])

    for batch in batches:
        for part in slices(batch, text):
            column = part.column(text)
            held.append((part.drop_columns([text]), *read(column)))
            size += column.nbytes
            if size >= limit:
                yield out()
                held, size, number = [], 0, number + 1
    if held:
        yield out()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as the largest needs, compressed; the first byte says how many."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(x.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], width * n, codec="zstd", asbytes=True), f"<u{width}").astype(np.int64)


def vocabulary(table: DataFrame, *columns: str) -> DataFrame:
    """(chunk, at, word, ...) of a table of chunks with arrays `word` and `columns` of equal length."""
    each = F.arrays_zip("word", *columns)
    return table.select(F.col("chunk").alias("_c"), F.posexplode(each).alias("at", "_w")).select(F.col("_c").alias("chunk"), "at", *[F.col(f"_w.{c}").alias(c) for c in ("word", *columns)])
