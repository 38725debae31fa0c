"""Near-duplicate vectors: spherical-cap filters of random product codes, and verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import by_group, components, written
from weft.llm.vectors import cosines, hashes, lengths, matrix, usable

#: Codes, parts of a code, filters of a code that a vector exceeds on average and at least, rows of a block in a comparison.
CODES, PARTS, FILTERS, LEAST, BLOCK = 4, 2, 32, 16, 1024


def code(dimension: int, rows: int, filters: int = FILTERS, parts: int = PARTS, seed: int = 5) -> dict:
    """Random rotation, codewords of each part and the threshold. The number of filters grows with the rows, so that buckets of unrelated vectors stay small; the threshold is such that a random vector exceeds `filters` of them."""
    rng = np.random.default_rng(seed)
    width = -(-dimension // parts)
    words = max(16, math.ceil((2 * max(1, rows)) ** (1 / parts)))
    rotation = np.linalg.qr(rng.standard_normal((width * parts, width * parts)))[0][:dimension]
    books = rng.standard_normal((parts, words, width))
    books /= np.linalg.norm(books, axis=2, keepdims=True)
    height = NormalDist().inv_cdf(1 - min(0.5, filters / words**parts)) / math.sqrt(width * parts)
    return {"rotation": rotation, "books": books, "threshold": height * math.sqrt(parts), "width": width}


def exceeded(x: np.ndarray, c: dict, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """List decoding: for each vector its filters, as prefixes (code of the first half of the parts), suffixes and how many each prefix has.

    Sums over either half are few; only prefixes that the best suffix lifts over the threshold are combined with sorted suffixes.
    A vector that lies far from all codewords would exceed next to none: its own threshold is then its `least`-th best sum, so that it meets its neighbours as well.
    """
    x = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
    y = (x @ c["rotation"]).reshape(len(x), len(c["books"]), c["width"])
    dots = np.einsum("npw,pbw->npb", y, c["books"])
    half = len(c["books"]) // 2

    def sums(parts: np.ndarray) -> np.ndarray:
        out = parts[:, 0]
        for k in range(1, parts.shape[1]):
            out = (out[:, :, None] + parts[:, k][:, None, :]).reshape(len(out), -1)
        return out

    head, tail = sums(dots[:, :half]), sums(dots[:, half:])
    order = np.argsort(-tail, axis=1)
    for i in range(len(x)):
        best = tail[i, order[i]]
        tops = np.sort(head[i])[: -least - 1 : -1]
        threshold = min(c["threshold"], np.sort((tops[:, None] + best[:least]).ravel())[-min(least, len(tops) * len(best[:least]))])
        prefixes = np.flatnonzero(head[i] >= threshold - best[0])
        many = np.searchsorted(-best, head[i, prefixes] - threshold, "right")
        suffixes = np.concatenate([order[i, :m] for m in many]) if len(many) else np.zeros(0, np.int64)
        yield prefixes, suffixes, many


def _decode(codes: list[dict], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            x = matrix(part.column("v"))
            rows, prefixes, suffixes = [], [], []
            for k, c in enumerate(codes):
                for i, (p, s, m) in enumerate(exceeded(x, c)):
                    rows.append(np.full(len(p), i))
                    prefixes.append(p + (k << 40))
                    suffixes += np.split(s.astype(np.int32), np.cumsum(m)[:-1]) if len(m) else []
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(prefixes).astype(np.int64)), pa.array(suffixes, pa.list_(pa.int32()))], ["id", "prefix", "suffixes"])


def _forest(linked: np.ndarray) -> np.ndarray:
    """Each row's smallest reachable row in a symmetric matrix of links."""
    label, n = np.arange(len(linked)), len(linked)
    while True:
        new = label.copy()
        for a in range(0, n, 256):
            new[a : a + 256] = np.minimum(new[a : a + 256], np.where(linked[a : a + 256], label, n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _edges(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each bucket compares all vectors; returns edges that connect what is linked, not all pairs."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        ids, x = group.column("id").to_numpy(), matrix(group.column("v"))
        lists = group.column("suffixes").combine_chunks()
        row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        suffix = lists.flatten().to_numpy()
        order = np.argsort(suffix, kind="stable")
        row, suffix = row[order], suffix[order]
        found = set()
        for bucket in np.split(row, np.flatnonzero(np.diff(suffix)) + 1):
            if len(bucket) < 2:
                continue
            linked = cosines(x[bucket], x[bucket]) >= threshold
            if not linked.any():
                continue
            label = _forest(linked)
            found.update((int(ids[bucket[k]]), int(ids[bucket[i]])) for i, k in enumerate(label.tolist()) if k != i)
        if found:
            a, b = np.array(sorted(found), np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return by_group(batches, ["d", "prefix", "i", "j"], work)


def _counts(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows linked to each row in its own block and in the other one of a pair of blocks of a component."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        ids, copies, block = (group.column(c).to_numpy() for c in ("id", "copies", "block"))
        x = matrix(group.column("v"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = cosines(x[left], x[right]) >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        out = [(ids[left], linked @ copies[right])]
        if i != j:
            out.append((ids[right], linked.T @ copies[left]))
        for own, n in out:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), group.column("d")[0].as_py(), np.int32)), pa.array(own), pa.array(n.astype(np.int64))], ["d", "id", "n"])

    return by_group(batches, ["component", "d", "i", "j"], work)


def in_blocks(rows: DataFrame, key: list[str], counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deals the rows of each key (as many as in `counted`) into blocks, and each row to all pairs (i, j) of blocks that its own one is part of."""
    sizes = written(counted.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    dealt = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "blocks")
    return dealt.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")


def near_duplicates(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, filters: int = FILTERS, codes: int = CODES) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of the table.

    Vectors link where their cosine in double precision is at least the threshold. Equal vectors form a class, and classes
    go on with a count. Each is decoded to all filter directions that it exceeds; filters with the same first half
    travel together, so a vector is sent once for them. In each bucket all vectors are compared, in pairs of blocks of BLOCK
    rows, and edges that connect what is linked are kept. Links are then counted within the components, again in
    pairs of blocks: only sums leave a task, not pairs. Work in a component grows with the square of its size, as does the number of its links.

    Vectors of one length are compared with each other, through filters where there are more than a few thousand, else directly; of different lengths they don't link.
    Vectors that are null, zero or hold null or non-finite components link with nothing: 0 links and a component of their own. Rows with a null id likewise, with a null component. Rows that repeat an id with
    different vectors are one node of a component, with links counted by each row's vector.
    """
    kind = table.schema[id_column].dataType.simpleString()
    rows = written(usable(table, id_column, vector))
    classes = written(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("d").alias("d"), F.first("v").alias("v")))
    many = lengths(classes)
    # short of an index: all vectors of a length are one bucket, which blocks deal out
    decoded = classes.filter(~F.col("d").isin(*many)).select("id", "d", F.lit(-1).cast("long").alias("prefix"), F.array(F.lit(0)).alias("suffixes"))
    for d, n in many.items():
        books = [code(d, n, filters, seed=5 + k) for k in range(codes)]
        found = classes.filter(F.col("d") == d).select("id", "v").mapInArrow(functools.partial(_decode, books), "id long, prefix long, suffixes array<int>")
        decoded = decoded.unionByName(found.withColumn("d", F.lit(d)))
    decoded = written(decoded)
    vectors = classes.select("id", "d", F.col("v").cast("array<float>").alias("v")) if dict(table.dtypes)[vector] == "array<float>" else classes.select("id", "d", "v")
    met = in_blocks(decoded.join(vectors, ["id", "d"]), ["d", "prefix"], decoded).select("d", "prefix", "i", "j", "id", F.col("v").cast("array<double>").alias("v"), "suffixes")
    edges = written(met.mapInArrow(functools.partial(_edges, threshold), "a long, b long").distinct())
    same = rows.join(classes.select("h1", "h2", F.col("id").alias("a")), ["h1", "h2"]).select("a", F.col("id").alias("b")).filter("a <> b").distinct()
    parts = written(components(edges.union(same)))
    inside = classes.join(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "id", "left_semi").join(parts, F.col("id") == F.col("node"))
    blocks = in_blocks(inside.select("component", "d", "id", "copies", "v"), ["component", "d"], inside).select("component", "d", "i", "j", "block", "id", "copies", "v")
    counts = written(blocks.mapInArrow(functools.partial(_counts, threshold), "d int, id long, n long").groupBy("d", "id").agg(F.sum("n").alias("n")))
    linked = rows.join(written(classes.select("h1", "h2", F.col("id").alias("c"), "copies")), ["h1", "h2"]).join(counts.withColumnRenamed("id", "c"), ["d", "c"], "left")
    linked = linked.select("id", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")).groupBy("id", "h1", "h2").agg(F.first("n_links").alias("n_links"))
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))
    every = table.select(F.col(id_column).cast("long").alias("_w_id"), *[h.alias(f"_w_h{i + 1}") for i, h in enumerate(hashes(v))])
    out = every.join(linked, (F.col("_w_id") == F.col("id")) & (F.col("_w_h1") == F.col("h1")) & (F.col("_w_h2") == F.col("h2")), "left").join(parts, F.col("_w_id") == F.col("node"), "left")
    component = F.coalesce("component", "_w_id")
    return out.select(F.col("_w_id").cast(kind).alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(component == F.col("_w_id"), F.lit(True)).alias("kept"))
