"""Packing tokenized documents into training sequences."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import slices, written

WINDOW, END_ID = 1024, 0
#: Added tokens of the tokenizer file, which the ranks file doesn't hold; texts that contain one get its id.
ADDED = {"<|endoftext|>": 50256}
#: Largest table of rank offsets that is broadcast; beyond it the offsets are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


@functools.lru_cache(2)
def _encoder(vocabulary: str):
    """The byte-level BPE of a ranks file; the same ids as the tokenizer file of the same vocabulary, in less time."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(vocabulary), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


@functools.lru_cache(2)
def _whole_encoder(vocabulary: str):
    """The tokenizer file of the same vocabulary: slower, but it takes runs of any length."""
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(str(public_tokenizers.path(vocabulary.replace(".tiktoken", ".json"))))


def encode(vocabulary: str, text: str) -> list[int]:
    """Ids of a whole text. The ranks' pattern gives up on runs of about a million spaces or line ends; such texts are encoded by the tokenizer file."""
    try:
        return _encoder(vocabulary).encode(text, allowed_special="all")
    except ValueError:
        return _whole_encoder(vocabulary).encode(text, add_special_tokens=False).ids


def _tokenize(vocabulary: str, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    chunks, ranks = 0, np.zeros(window, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            ids = [np.array([*encode(vocabulary, t or ""), END_ID], "<u2") for t in part.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            full, rest = n // window, n % window
            start = chunks + np.cumsum(full) - full
            chunks += int(full.sum())
            rank = np.zeros(len(n), np.int64)
            for i, r in enumerate(rest.tolist()):
                rank[i] = ranks[r]
                ranks[r] += 1
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n), pa.array(rest), pa.array(np.full(len(n), task, np.int64)), pa.array(start), pa.array(rank)], ["id", "ids", "n", "rest", "task", "chunk", "rank"])


def combinations(window: int, depth: int = 3) -> np.ndarray:
    """All ways to fill the window with at most `depth` (2 or 3) lengths below it: rows of ascending lengths, 0 for none."""
    a = np.arange(1, window // 2 + 1)
    found = [np.stack([np.zeros_like(a), a, window - a], 1)]
    if depth >= 3:
        x, y = np.meshgrid(np.arange(1, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
        z = window - x - y
        keep = (x <= y) & (y <= z)
        found.append(np.stack([x[keep], y[keep], z[keep]], 1))
    return np.concatenate(found)


def repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: how often to use each combination so that lengths come as often as in the histogram.

    Accelerated projected gradient; a length's error weighs by the length, so that tokens count alike. The work depends on the window, never on the number of documents.
    """
    window = len(histogram)
    weight = np.sqrt(np.arange(window) / window)
    weight[0] = 0
    scale = max(1.0, float(histogram.max()))
    goal = histogram / scale * weight

    def lengths(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, k], x, window) for k in range(combos.shape[1])) * weight

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return sum(r[combos[:, k]] for k in range(combos.shape[1]))

    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue
        v = back(lengths(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(lengths(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(lengths(y) - goal))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(histogram: np.ndarray, depth: int = 3) -> dict[str, np.ndarray | int]:
    """Where pieces go, by length and rank: ranges of ranks that fill combinations, and the residual stream behind them.

    histogram[L]: pieces of length L below the window. The rounded repeats are used as far as pieces last, most used first;
    what is left over is packed greedily, long pieces first, each sequence filled to its end by cutting the piece that
    crosses it.
    """
    window = len(histogram)
    combos = combinations(window, depth)
    x = np.round(repeats(histogram, combos)).astype(np.int64)
    left, slots, sequences = histogram.astype(np.int64).copy(), [], 0
    left[0] = 0
    for c in np.argsort(-x, kind="stable"):
        if x[c] <= 0:
            break
        kinds, many = np.unique(combos[c][combos[c] > 0], return_counts=True)
        use = int(min(x[c], (left[kinds] // many).min()))
        if use <= 0:
            continue
        offset = 0
        for length in combos[c][combos[c] > 0][::-1].tolist():
            slots.append((length, int(histogram[length] - left[length]), use, sequences, offset))
            left[length] -= use
            offset += length
        sequences += use
    slots.sort()
    order = np.arange(window)[::-1]
    streamed = np.zeros(window, np.int64)
    streamed[order] = np.cumsum(left[order] * order) - left[order] * order
    s = np.array(slots, np.int64).reshape(-1, 5)
    return {"length": s[:, 0], "first": s[:, 1], "count": s[:, 2], "sequence": s[:, 3], "offset": s[:, 4], "used": histogram.astype(np.int64) - left, "stream": streamed, "residual": int((left * np.arange(window)).sum()), "sequences": sequences}


def _cuts(residual: int, window: int) -> np.ndarray:
    """Ends of the sequences in the residual stream's last, partial window: powers of two, so that nothing is padded."""
    tail, at, out = residual % window, residual - residual % window, [0]
    for bit in range(window.bit_length(), -1, -1):
        if tail >> bit & 1:
            out.append(out[-1] + (1 << bit))
    return np.array(out, np.int64) + at


def _place(window: int, p: dict, chunks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = p["length"] * (1 << 40) + p["first"]
    whole, tail = p["residual"] // window, _cuts(p["residual"], window)
    for batch in batches:
        out: list[tuple] = []
        crcs: list[int] = []
        chunk, rank, rest = (batch.column(c).to_numpy() for c in ("chunk", "rank", "rest"))
        slot = np.searchsorted(key, rest * (1 << 40) + rank, "right") - 1
        for i, raw in enumerate(batch.column("ids")):
            ids = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
            n, r = len(ids), int(rest[i])
            pieces = [(k * window, window, int(chunk[i]) + k, 0) for k in range(n // window)]
            if r:
                begin = n - r
                if rank[i] < p["used"][r]:
                    s = slot[i]
                    pieces.append((begin, r, chunks + int(p["sequence"][s] + rank[i] - p["first"][s]), int(p["offset"][s])))
                else:
                    at = int(p["stream"][r] + (rank[i] - p["used"][r]) * r)
                    end = at + r
                    while at < end:
                        if at < whole * window:
                            sequence, first = divmod(at, window)
                            stop = (sequence + 1) * window
                        else:
                            t = int(np.searchsorted(tail, at, "right")) - 1
                            sequence, first, stop = whole + t, at - int(tail[t]), int(tail[t + 1])
                        length = min(end, stop) - at
                        pieces.append((begin, length, chunks + int(p["sequences"]) + sequence, first))
                        begin, at = begin + length, at + length
            for start, length, *_ in pieces:
                crcs.append(zlib.crc32(ids[start : start + length].data))
            out += [(i, a, b, n, c, d) for a, b, c, d in pieces]
        cols = np.array(out, np.int64).reshape(-1, 6).T
        row, start, length, n, sequence, offset = (pa.array(c) for c in cols)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(row), start, length, pa.array(crcs, pa.int64()), n, sequence, offset], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def tokens(documents: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", window: int = WINDOW) -> DataFrame:
    """A written table of each row's ids (16-bit, little-endian, the end id last) with its places within its task."""
    kind = documents.schema[id_column].dataType.simpleString()
    given = documents.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    return written(given.mapInArrow(functools.partial(_tokenize, vocabulary, window), f"id {kind}, ids binary, n long, rest long, task long, chunk long, rank long"))


def pack(documents: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", window: int = WINDOW, depth: int = 3) -> DataFrame:
    """Pieces of documents in sequences: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each row becomes its ids and an end id; null and empty texts are the end id alone, repeated rows and ids are rows of their
    own, an empty table gives no pieces. Whole windows of long documents are sequences; the rests are packed by combinations
    of at most `depth` lengths whose repeat counts solve a non-negative least squares problem on the histogram of lengths
    (window - 1 numbers on the driver), what rounding leaves by greedy filling, where pieces are cut so that no sequence
    is padded: the last ones have powers of two as lengths. A row's rank among rests of its length is its rank within the
    task that tokenized it plus that task's offset; while the offsets are few enough for a broadcast (up to 4,096 tasks) neither
    ids nor texts are shuffled, beyond that the ids once, by task.
    """
    rows = tokens(documents, id_column, text, vocabulary, window)
    counts = rows.groupBy("task", "rest").agg(F.count(F.lit(1)).alias("c"))
    chunks = rows.groupBy("task").agg(F.sum(F.col("n") - F.col("rest")).alias("w"))
    counts, chunks = written(counts), written(chunks)
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # at most `window` rows
        histogram[r["rest"]] = r["c"]
    total = chunks.agg(F.sum("w"), F.count(F.lit(1))).first()
    p = plan(histogram, depth)
    offsets = counts.select("task", "rest", F.expr("sum(c) over (partition by rest order by task rows between unbounded preceding and 1 preceding)").alias("o"))
    offsets = offsets.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("rest", F.coalesce("o", F.lit(0))))).alias("o"))
    offsets = offsets.join(chunks.select("task", F.expr(f"coalesce(sum(w) over (order by task rows between unbounded preceding and 1 preceding), 0) div {window}").alias("before")), "task")
    offsets = written(offsets)
    if total[1] * window * 16 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, "task").select("id", "ids", "rest", (F.col("chunk") + F.col("before")).alias("chunk"), (F.col("rank") + F.col("o")[F.col("rest")]).alias("rank"))
    kind = documents.schema[id_column].dataType.simpleString()
    out = placed.mapInArrow(functools.partial(_place, window, p, int((total[0] or 0) // window)), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_column)
