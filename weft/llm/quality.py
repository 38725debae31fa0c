"""Quality scores of documents by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import shingle_hashes, slices, word_hashes, written

#: Statistics of a text, in the order of the feature vector.
FEATURES = ("words", "word_length", "upper", "symbols", "digits", "stops", "pipes", "marks", "distinct", "top", "repeats", "shingles", "lines", "same_lines", "entropy")
#: Part of the pooled covariance in each class's, and of the identity in that.
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.01


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Byte classes: upper, lower and other letters, digits, sentence ends, pipes, exclamation and question marks, other symbols, space, line end."""
    out = np.full(256, 7, np.int64)
    out[65:91], out[97:123], out[128:], out[48:58] = 0, 1, 2, 3
    for c in b".,;:'\"-":
        out[c] = 4
    out[ord("|")] = 5
    out[[ord("!"), ord("?")]] = 6
    out[[32, 9, 11, 12, 13]] = 8
    out[10] = 9
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log((p + 1e-3) / (1 - p + 1e-3))


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics of whole texts, a row for each: counts as logarithms, shares as smoothed logits. All 0-ish for an empty text, never NaN."""
    n = len(texts)
    words, at = word_hashes(texts)
    strings = texts.to_pylist()
    out = np.zeros((n, len(FEATURES)))
    classes = _classes()
    for i, text in enumerate(strings):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        total = max(1, len(raw))
        counts = np.bincount(raw, minlength=256)
        c = np.bincount(classes, counts, 10)
        letters = max(1.0, c[0] + c[1] + c[2])
        w = words[at[i] : at[i + 1]]
        k = max(1, len(w))
        some, times = np.unique(w, return_counts=True)
        shingles = shingle_hashes(w)
        lines = (text or "").split("\n")
        used = [x for x in lines if x]
        p = counts[counts > 0] / total
        out[i] = (
            np.log1p(len(w)),
            np.log1p((total - c[8] - c[9]) / k),
            c[0] / letters,
            c[7] / total,
            c[3] / total,
            c[4] / k,
            c[5] / k,
            c[6] / k,
            np.log(max(1, len(some))) / np.log(k + 1.0),
            times.max() / k if len(w) else 0,
            np.count_nonzero(w[1:] == w[:-1]) / k,
            1 - len(np.unique(shingles)) / max(1, len(shingles)),
            np.log1p(k / max(1, len(used))),
            1 - len(set(used)) / max(1, len(used)),
            -(p * np.log2(p)).sum() if len(raw) else 0,
        )
    for f in ("upper", "symbols", "digits", "stops", "pipes", "marks", "top", "repeats", "shingles", "same_lines"):
        j = FEATURES.index(f)
        out[:, j] = _logit(np.clip(out[:, j], 0, 1))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = statistics(part.column("text"))
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], [*kept, "x"])


def _moments(centre: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class and task: count, sums and sums of products of the features less `centre`, as (class, place, value)."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, d) - centre
        label = batch.column("label").to_numpy()
        for k in (0, 1):
            own = x[label == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    m = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], m)), pa.array(np.tile(np.arange(m), 2)), pa.array(total.ravel())], ["label", "place", "value"])


def discriminant(moments: np.ndarray, pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> dict[str, np.ndarray | float]:
    """Means, inverse Cholesky factors and log-determinants of both classes from their summed moments.

    On features scaled to unit pooled variance, a class's covariance is shrunk towards the pooled one and then towards the
    identity. A class without rows takes the other's moments, none at all gives a score of the prior.
    """
    d = len(FEATURES)
    n = moments[:, 0]
    if n.sum() == 0:
        moments = np.zeros_like(moments)
        moments[:, 0] = 1
        moments[:, 1 + d :] = np.eye(d).ravel()
    elif (n == 0).any():
        moments = np.where((n == 0)[:, None], moments[::-1] * 1.0, moments)
    weight = (n + 1) / (n.sum() + 2)
    n = moments[:, 0]
    mean = moments[:, 1 : d + 1] / n[:, None]
    cov = moments[:, d + 1 :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    both = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both), 1e-9))
    white, logdet = [], []
    for k in (0, 1):
        s = ((1 - pooled) * cov[k] + pooled * both) / np.outer(scale, scale)
        s = (1 - diagonal) * (s + s.T) / 2 + diagonal * np.eye(d)
        factor = np.linalg.cholesky(s)
        white.append(np.linalg.inv(factor) / scale)
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return {"mean": mean, "white": np.stack(white), "logdet": np.array(logdet), "prior": np.log(weight)}


def _score(model: dict, temperature: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
        log = [model["prior"][k] - 0.5 * (((x - model["mean"][k]) @ model["white"][k].T) ** 2).sum(1) - 0.5 * model["logdet"][k] for k in (0, 1)]
        score = 1 / (1 + np.exp(np.clip((log[0] - log[1]) / temperature, -500, 500)))
        kept = [c for c in batch.schema.names if c != "x"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(score)], [*kept, "score"])


def held_out(id_column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def score(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, temperature: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, score, predicted) and the columns in `keep` for each row of documents; score is the probability of label 1.

    Learns from all labelled rows whose crc32(id as text) mod 5 isn't 0: two classes' moments are summed in tasks and then
    by place, around the means that a first pass finds, so the driver gets twice 2 * (1 + d + d * d) numbers. Scores are differences of Mahalanobis log-densities with
    factors that are computed once. Null and empty texts are scored like any (their statistics are 0); a null id is never labelled nor held out;
    rows that repeat an id are scored each; of several labels for an id the smallest counts, null labels don't.
    """
    kinds = "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    given = f"id {documents.schema[id_column].dataType.simpleString()}{kinds}"
    x = documents.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), *keep).mapInArrow(_features, f"{given}, x array<double>")
    x = written(x)
    known = labels.select(F.col(id_column).alias("_l"), F.col(label).cast("long").alias("label")).filter("label in (0, 1)").groupBy("_l").agg(F.min("label").alias("label"))
    learned = written(x.filter(~held_out("id")).join(known, F.col("id") == F.col("_l")).select("x", "label"))

    def moments(centre: np.ndarray) -> np.ndarray:
        out = np.zeros((2, 1 + len(FEATURES) + len(FEATURES) ** 2))
        sums = learned.mapInArrow(functools.partial(_moments, centre), "label long, place long, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
        for r in sums.collect():  # as many numbers as the model has
            out[r["label"], r["place"]] = r["value"]
        return out

    first = moments(np.zeros(len(FEATURES)))
    centre = first[:, 1 : 1 + len(FEATURES)].sum(0) / max(1.0, first[:, 0].sum())
    model = discriminant(moments(centre))
    model["mean"] = model["mean"] + centre
    scored = x.mapInArrow(functools.partial(_score, model, temperature), f"{given}, score double")
    return scored.select(F.col("id").alias(id_column), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"), *keep)
