"""Importance resampling of documents towards a target distribution of n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import lexicon
from weft.operators.relational import numbered
from weft.scratch import written

#: ASCII characters of words.
SOLID = b"0123456789abcdefghijklmnopqrstuvwxyz"


def features(longest: int, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to `longest` consecutive words of each text, joined by one space, and each text's first run."""
    words, at = lexicon.words(texts, SOLID)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, owners, runs = [words], [owner], words
    for k in range(2, longest + 1):
        if len(words) < k:
            break
        runs = pc.binary_join_element_wise(runs.slice(0, len(words) - k + 1), words.slice(k - 1), pa.scalar(" ", pa.large_string()))
        whole = owner[: len(words) - k + 1] == owner[k - 1 :]
        found.append(runs.filter(pa.array(whole)))
        owners.append(owner[k - 1 :][whole])
    if len(found) == 1:
        return words, at
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=len(at) - 1)
    return pa.concat_arrays(found).take(pa.array(order)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _counted(longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its distinct features and how often they occur; its documents' ids, numbers of features and of distinct ones, and these as codes with counts."""
    for chunk, docs, at, codes, vocabulary in lexicon.chunks(functools.partial(features, longest), "text", lexicon.CHUNK_BYTES, batches):
        size = max(1, len(vocabulary))
        owner = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
        own, counts = np.unique(owner * size + codes, return_counts=True)
        distinct = np.bincount(own // size, minlength=len(at) - 1)
        lists = [vocabulary, pa.array(np.bincount(codes, minlength=len(vocabulary))), docs.column("id").combine_chunks(), pa.array(np.diff(at)), pa.array(distinct)]
        columns = [pa.array([chunk]), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]]
        columns += [pa.array([lexicon.packed(x)], pa.binary()) for x in (own % size, counts)]
        yield pa.RecordBatch.from_arrays([c.cast(pa.list_(pa.string())) if i == 1 else c for i, c in enumerate(columns)], ["chunk", "word", "n", "ids", "n_features", "distinct", "codes", "counts"])


def _chunks(docs: DataFrame, text: str, kind: str, longest: int) -> DataFrame:
    given = docs.select(F.col("id"), F.col(text).cast("string").alias("text"))
    return written(given.mapInArrow(functools.partial(_counted, longest), f"chunk long, word array<string>, n array<long>, ids array<{kind}>, n_features array<long>, distinct array<long>, codes binary, counts binary"))


def _weights(parts: pa.Table, gains: pa.Table) -> pa.Table:
    """Weights of one chunk's documents: the floored means of their features' gains."""
    found = np.zeros(gains.num_rows, np.int64)
    found[gains.column("at").to_numpy()] = gains.column("gain").to_numpy()
    out = []
    for row in parts.select(["chunk", "codes", "counts"]).to_pylist():
        sums = np.concatenate([[0], np.cumsum(found[lexicon.unpacked(row["codes"])] * lexicon.unpacked(row["counts"]))])
        ids, n, distinct = (parts.column(c).combine_chunks().flatten() for c in ("ids", "n_features", "distinct"))
        end = np.cumsum(distinct.to_numpy())
        total, n = sums[end] - sums[end - distinct.to_numpy()], n.to_numpy()
        out.append(pa.table([pa.array(np.full(len(n), row["chunk"])), pa.array(np.arange(len(n))), ids, pa.array(n), pa.array(total // np.maximum(n, 1))], ["chunk", "at", "id", "n_features", "weight"]))
    return pa.concat_tables(out) if out else pa.table({"chunk": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "id": parts.column("ids").combine_chunks().flatten(), "n_features": pa.array([], pa.int64()), "weight": pa.array([], pa.int64())})


def gains(dictionary: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of a written dictionary (bucket, s, t): floored thousandths of the smoothed log-ratio of target to source; at most `buckets` rows."""
    total = dictionary.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    sums = dictionary.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    ratio = (F.col("t") + 1) * F.lit(float(total[0] + buckets)) / ((F.col("s") + 1) * F.lit(float(total[1] + buckets)))
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def resample(documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of documents; `percent` of those with `least_words` words are drawn, and ranked from 1.

    Features are counted as strings over all documents, and over all of the target; each distinct one is hashed once, and buckets
    are sums over that dictionary. Gains come back to a chunk of documents once for each of its distinct features. Scores are weights
    plus seeded Gumbel noise in thousandths, so the highest are a sample without replacement.
    Null and empty texts have no features, weight 0, and are scored like any; a null id has the noise of an empty one and comes last of equals;
    repeated rows are scored and drawn each for themselves. Without documents there are no rows; an empty target is a flat one.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    parts = _chunks(documents.select(F.col(id_column).alias("id"), F.col(text)), text, kind, longest)
    aims = _chunks(target.select(F.lit(0).cast("long").alias("id"), F.col(target_text)), target_text, "bigint", longest)
    none = F.lit(0).cast("long")
    counted = lexicon.vocabulary(parts, "n").select("word", F.col("n").alias("s"), none.alias("t")).union(lexicon.vocabulary(aims, "n").select("word", none, "n"))
    counted = counted.groupBy("word").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    dictionary = written(counted.withColumn("bucket", F.crc32("word") % buckets))
    gained = dictionary.filter("s > 0").join(F.broadcast(gains(dictionary, buckets)), "bucket").select("word", "gain")
    back = lexicon.vocabulary(parts).join(gained, "word").select("chunk", "at", "gain")
    weighed = parts.select("chunk", "ids", "n_features", "distinct", "codes", "counts").groupBy("chunk").cogroup(back.groupBy("chunk"))
    weighed = weighed.applyInArrow(_weights, f"chunk long, at long, id {kind}, n_features long, weight long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    enough = sum(max(0, least_words - k + 1) for k in range(1, longest + 1))
    scored = written(weighed.select("chunk", "at", "id", "n_features", "weight", score.alias("score"), (F.col("n_features") >= enough).alias("drawable")))
    drawn = scored.filter("drawable").count() * percent // 100
    placed = numbered(scored, [F.col("drawable").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("chunk"), F.col("at")], "place")
    return placed.select(F.col("id").alias(id_column), "n_features", "weight", "score", F.when(F.col("drawable") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
