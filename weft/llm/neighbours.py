"""Approximate nearest neighbours: balanced posting lists, replicated at their borders, found by a graph of centroids."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import written
from weft.llm.vectors import cosines, lengths, matrix, usable

#: Vectors that the index is fitted on at most, vectors to a list, lists at most, lists that hold a vector at most.
SAMPLE, LIST, MAX_LISTS, REPLICAS = 16384, 128, 4096, 6
#: Cells that neighbouring lists lie in together, queries that a task holds for a cell at most.
CELLS, QUERIES = 64, 8192
#: How much farther than the nearest centroid a replica's centroid may be.
BORDER = 1.25
#: Share of a sample's true neighbours that the distance ratio of a search must reach.
GOAL, NEIGHBOURS, DEGREE = 0.975, 5, 24


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Unit centroids of clusters of equal size, by halving along the axis between two means again and again."""
    rng, out, todo = np.random.default_rng(seed), [], [(np.arange(len(x)), lists)]
    while todo:
        own, k = todo.pop()
        if k <= 1 or len(own) < 2:
            out.append(x[own].mean(0))
            continue
        c = x[own[rng.choice(len(own), 2, replace=False)]]
        for _ in range(6):
            d = x[own] @ (c[0] - c[1])
            high = np.argsort(-d, kind="stable")
            cut = len(own) * (k // 2) // k
            c = np.stack([x[own[high[:cut]]].mean(0), x[own[high[cut:]]].mean(0)])
        todo += [(own[high[:cut]], k // 2), (own[high[cut:]], k - k // 2)]
    c = np.stack(out)
    length = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(length > 1e-12, c / np.maximum(length, 1e-12), x[:1])


def graph(centroids: np.ndarray, degree: int = DEGREE, seed: int = 4) -> np.ndarray:
    """Neighbours of each centroid: the nearest ones and, for reach, some random ones."""
    n = len(centroids)
    near = np.empty((n, min(degree, n)), np.int64)
    for a in range(0, n, 1024):
        near[a : a + 1024] = np.argsort(-(centroids[a : a + 1024] @ centroids.T), axis=1, kind="stable")[:, : min(degree, n)]
    return np.concatenate([near, np.random.default_rng(seed).integers(0, n, (n, 8))], 1)


def search(x: np.ndarray, centroids: np.ndarray, links: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks the graph for all rows of x at once: (row, centroid, distance) within `ratio` of the row's nearest one found.

    From common entries on, centroids within the ratio of the best so far are expanded until none is new.
    """
    n, m = len(x), len(centroids)
    entries = np.unique(np.linspace(0, m - 1, 16).astype(np.int64))
    distance = np.full((n, m), np.inf, np.float32)
    row, node = np.repeat(np.arange(n), len(entries)), np.tile(entries, n)
    best = np.full(n, np.inf)
    expanded = np.zeros((n, m), bool)
    while len(row):
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[row], centroids[node])))
        distance[row, node] = d
        np.minimum.at(best, row, d)
        wide = np.maximum(ratio, 1.05) * best
        row, node = np.nonzero((distance <= wide[:, None]) & ~expanded)
        expanded[row, node] = True
        flag = np.zeros((n, m), bool)
        flag[np.repeat(row, links.shape[1]), links[node].ravel()] = True
        row, node = np.nonzero(flag & np.isinf(distance))
    row, node = np.nonzero(distance <= (ratio * best + 1e-6)[:, None])
    return row, node, distance[row, node]


def assign(x: np.ndarray, centroids: np.ndarray, links: np.ndarray, border: float = BORDER, replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): each row's nearest list, and as a replica the next ones within the border ratio."""
    row, node, d = search(x, centroids, links, border)
    order = np.lexsort((node, d, row))
    row, node = row[order], node[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < replicas], node[place < replicas]


def fit(x: np.ndarray, rows: int) -> dict:
    """Centroids, their graph, the number of replicas and the search ratio, from a sample of unit vectors.

    The ratio is the least one that finds GOAL of the true neighbours of sample queries in the sample, checked by brute force.
    Replicas are as many as let these queries read the fewest vectors at their ratio: vectors in clusters gain by them,
    nearly random ones are only read more often.
    """
    lists = int(max(1, min(MAX_LISTS, rows // LIST, len(x) // 4)))
    centroids = balanced(x, lists)
    links = graph(centroids)
    index = {"centroids": centroids, "links": links, "replicas": 1, "ratio": 1e9}
    if lists <= 8:
        return index
    held = np.full((len(x), REPLICAS), -1)
    for a in range(0, len(x), 256):  # in slices: a search takes memory for each row and centroid
        row, node = assign(x[a : a + 256], centroids, links)
        held[a + row, np.arange(len(row)) - np.searchsorted(row, row)] = node
    queries = np.random.default_rng(6).choice(len(x), min(512, len(x)), replace=False)
    true = np.empty((len(queries), min(NEIGHBOURS, len(x) - 1)), np.int64)
    for a in range(0, len(queries), 64):
        own = queries[a : a + 64]
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -2
        true[a : a + 64] = np.argpartition(-near, true.shape[1], axis=1)[:, : true.shape[1]]
    far = np.sqrt(np.maximum(0, 2 - 2 * x[queries] @ centroids.T))
    far = np.concatenate([far / np.maximum(far.min(1, keepdims=True), 1e-9), np.full((len(queries), 1), np.inf)], 1)
    least = np.inf
    for replicas in range(1, REPLICAS + 1):
        own = held[:, :replicas]
        ratio = float(np.quantile(far[np.arange(len(queries))[:, None, None], own[true]].min(2), GOAL)) + 1e-6
        reads = ((far[:, :-1] <= ratio) @ np.bincount(own[own >= 0], minlength=lists)).mean()
        if reads < least:
            least, index = reads, index | {"replicas": replicas, "ratio": ratio}
    return index


def _postings(index: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists that hold each vector, with their cells."""
    lists = len(index["centroids"])
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            row, node = assign(_unit(matrix(part.column("v"))), index["centroids"], index["links"], replicas=index["replicas"])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("v").take(take), pa.array(node * min(CELLS, lists) // lists), pa.array(node)], ["id", "v", "cell", "list"])


def _visits(index: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that each query visits, with its lists there."""
    lists = len(index["centroids"])
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            row, node = search(_unit(matrix(part.column("v"))), index["centroids"], index["links"], index["ratio"])[:2]
            cell = node * min(CELLS, lists) // lists
            cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(cell) != 0)) + 1
            first = np.concatenate([[0], cuts])
            take, edges = pa.array(row[first]), pa.array(np.append(first, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("v").take(take), pa.array(cell[first]), pa.ListArray.from_arrays(edges, pa.array(node))], ["id", "v", "cell", "lists"])


class _Best:
    """The k + 1 nearest classes so far of the queries that a task holds for a cell."""

    def __init__(self, k: int, queries: pa.Table):
        self.ids, self.x = queries.column("id").to_numpy(), matrix(queries.column("v"))
        lists = queries.column("lists").combine_chunks()
        row, self.lists = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        order = np.argsort(self.lists, kind="stable")
        self.rows, self.lists = row[order], self.lists[order]
        self.score, self.near = np.full((len(self.ids), k + 1), -np.inf), np.full((len(self.ids), k + 1), -1, np.int64)

    def meet(self, which: int, ids: np.ndarray, v: np.ndarray) -> None:
        """Compares vectors of list `which` with the queries that visit it."""
        rows = self.rows[np.searchsorted(self.lists, which) : np.searchsorted(self.lists, which, "right")]
        for a in range(0, len(rows), 256):
            own = rows[a : a + 256]
            score = cosines(self.x[own], v)
            r, c = np.nonzero(score >= self.score[own, -1:])
            if not len(r):
                continue
            touched = own[np.unique(r)]
            width = self.score.shape[1]
            row = np.concatenate([np.repeat(touched, width), own[r]])
            near, score = np.concatenate([self.near[touched].ravel(), ids[c]]), np.concatenate([self.score[touched].ravel(), score[r, c]])
            row, near, score = (x[score > -np.inf] for x in (row, near, score))
            order = np.lexsort((-score, near, row))  # a replica may be here from another list
            row, near, score = row[order], near[order], score[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (near[1:] != near[:-1])
            row, near, score = row[fresh], near[fresh], score[fresh]
            order = np.lexsort((near, -score, row))
            row, near, score = row[order], near[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < width
            self.score[row[kept], place[kept]], self.near[row[kept], place[kept]] = score[kept], near[kept]

    def found(self, d: int) -> pa.RecordBatch:
        row, place = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(self.ids[row]), pa.array(self.near[row, place]), pa.array(self.score[row, place])], ["d", "q", "c", "score"])


def _nearest(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k + 1 nearest classes in a cell for each of its query classes. Of sorted rows the queries of (d, cell, e) come first and are held, its lists stream past them."""
    group, held, best = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        d, cell, e, which = (batch.column(c).to_numpy() for c in ("d", "cell", "e", "list"))
        query, ids = batch.column("query").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
        change = np.zeros(batch.num_rows - 1, bool)
        for c in (d, cell, e, query, which):
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if group != (d[a], cell[a], e[a]):
                if best:
                    yield best.found(int(group[0]))
                group, held, best = (d[a], cell[a], e[a]), [], None
            if query[a]:
                held.append(batch.slice(a, b - a))
                continue
            if held and not best:
                best = _Best(k, pa.Table.from_batches(held))
            if best:
                best.meet(which[a], ids[a:b], matrix(batch.column("v").slice(a, b - a)))
    if best:
        yield best.found(int(group[0]))


def nearest(table: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where `is_query` holds, by cosine in double precision, ties to the smaller id; all other rows are candidates, the query's own isn't.

    Equal vectors form a class with its k + 1 smallest ids. The index is fitted on at most SAMPLE classes, taken by hash;
    every class goes to its nearest list and, near borders, to up to REPLICAS if that lets queries read less. A query visits
    the lists within the fitted distance ratio of its nearest one. Neighbouring lists lie in one of CELLS cells; a query goes
    to a cell once, the lists stream past up to QUERIES of them, and a cell returns k + 1 classes for a query.
    Each length of vectors has an index of its own, lengths of a few thousand vectors at most are compared whole; vectors of different lengths aren't near each other.
    Rows with a null id, or a vector that is null, zero or holds null or non-finite components, take no part. Repeated ids count as one candidate; a query never finds its own id.
    """
    kind = table.schema[id_column].dataType.simpleString()
    rows = written(usable(table.select(id_column, vector), id_column, vector).dropDuplicates(["id", "h1", "h2"]))
    small = rows.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("r") <= k + 1)
    classes = written(small.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"), F.first("d").alias("d"), F.first("v").alias("v")))
    asked = written(rows.select("h1", "h2", F.col("id").alias(id_column)).filter(is_query).withColumnRenamed(id_column, "query").join(classes.select("h1", "h2", "d", F.col("id").alias("q")), ["h1", "h2"]).select("query", "d", "q"))
    queries = written(classes.select("id", "d", "v").join(asked.select(F.col("q").alias("id"), "d").distinct(), ["id", "d"], "left_semi"))
    many = lengths(classes)
    whole = lambda df, *more: df.filter(~F.col("d").isin(*many)).select("d", "id", "v", F.lit(-1).cast("long").alias("cell"), *more)
    postings, visits = whole(classes, F.lit(-1).cast("long").alias("list")), whole(queries, F.array(F.lit(-1).cast("long")).alias("lists"))
    for d, n in many.items():
        own = classes.filter(F.col("d") == d)
        sample = own.orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow().column("v")
        index = fit(_unit(matrix(sample)).astype(np.float32), n)
        listed = own.select("id", "v").mapInArrow(functools.partial(_postings, index), "id long, v array<double>, cell long, list long")
        asking = queries.filter(F.col("d") == d).select("id", "v").mapInArrow(functools.partial(_visits, index), "id long, v array<double>, cell long, lists array<long>")
        postings, visits = postings.union(listed.select(F.lit(d).alias("d"), "id", "v", "cell", "list")), visits.union(asking.select(F.lit(d).alias("d"), "id", "v", "cell", "lists"))
    postings, visits = written(postings), written(visits)
    sizes = written(visits.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("es")))
    left = postings.join(sizes, ["d", "cell"]).select("d", "cell", F.explode(F.expr("sequence(0, es - 1)")).alias("e"), F.lit(False).alias("query"), "list", F.lit(None).cast("array<long>").alias("lists"), "id", "v")
    right = visits.join(sizes, ["d", "cell"]).select("d", "cell", F.pmod(F.xxhash64("id"), F.col("es")).cast("int").alias("e"), F.lit(True).alias("query"), F.lit(-2).cast("long").alias("list"), "lists", "id", "v")
    met = left.unionByName(right).repartition("d", "cell", "e").sortWithinPartitions("d", "cell", "e", F.desc("query"), "list")
    found = met.mapInArrow(functools.partial(_nearest, k), "d int, q long, c long, score double").groupBy("d", "q", "c").agg(F.max("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("d", "q").orderBy(F.desc("score"), "c"))).filter(F.col("r") <= k + 1).drop("r")
    found = written(found.join(classes.select("d", F.col("id").alias("c"), "ids"), ["d", "c"]).select("d", "q", "score", F.explode("ids").alias("vec")))
    every = asked.join(found, ["d", "q"]).filter("query <> vec").groupBy("query", "vec").agg(F.max("score").alias("score"))
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec"))).filter(F.col("rank") <= k)
    return every.select(F.col("query").cast(kind).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec").cast(kind).alias(id_column), "score")
