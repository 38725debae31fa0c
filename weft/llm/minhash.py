"""Near-duplicate documents: circulant MinHash, banding, and verification on full shingle sets."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import by_group, components, having, mix, shingle_hashes, slices, word_hashes, written

#: A pair at similarity 0.75 meets in none of the 40 bands of 5 coordinates with probability 2e-5, one at 0.8 with 1e-7.
BANDS, ROWS, WORDS = 40, 5, 5
UNIVERSE = 1 << 20
#: Larger sets are thinned by the factor, again and again, so that they leave most of the universe free; sets near a limit are signed on both sides of it.
LARGE, FACTOR, NEAR = 1 << 18, 64, 0.7
#: Residual groups are compared in blocks of so many documents and about so many shingles, after so many rounds of comparing with one member.
BLOCK, BLOCK_SHINGLES, ROUNDS = 1024, 1 << 21, 2
#: A pair goes on to its full sets unless its signatures agree in so many standard deviations less than the similarity asks for.
DEVIATIONS = 5.5


@functools.lru_cache(2)
def _circle(coordinates: int, seed: int) -> np.ndarray:
    """The second permutation, of the universe, with its beginning again at the end; row i is what element i gives to all shifts."""
    table = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """Circulant MinHash: the first permutation (a bijection of hashes, cut to the universe) places each shingle on a circle; coordinate k is the least value of the second permutation shifted by k."""
    circle = _circle(coordinates, seed)
    places = (mix(shingles ^ np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    out = np.full(coordinates, UNIVERSE, np.uint32)
    for i in range(0, len(places), 4096):
        np.minimum(out, circle[places[i : i + 4096]].min(0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int, level: int = 0) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(level << 32)
    for column in sig.reshape(bands, rows).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def levels(n: int, large: int = LARGE) -> list[int]:
    """How often a set of n shingles is thinned, one or two numbers: similar sets have one in common, whatever their sizes."""
    out, most, k = [], large, 0
    while True:
        if n <= most:
            out.append(k)
            if n < NEAR * most:
                return out
        most, k = most * FACTOR, k + 1


def thinned(shingles: np.ndarray, level: int) -> np.ndarray:
    """The part of a set that is chosen by a hash of its own, the same shingles in each set."""
    return shingles[mix(shingles + np.uint64(0x5851F42D4C957F2D)) % np.uint64(FACTOR**level) == 0] if level else shingles


def _sign(words: int, bands: int, rows: int, large: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, at = word_hashes(part.column("text"))
            n, digest, keys, low = [], [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = np.unique(shingle_hashes(hashes[a:b], words))
                n.append(len(own))
                if not len(own):
                    digest.append(None), keys.append(None), low.append(None)
                    continue
                signs = [(k, signature(thinned(own, k), bands * rows)) for k in levels(len(own), large)]
                digest.append(hashlib.blake2b(own.data, digest_size=16).digest())
                keys.append(np.concatenate([band_keys(sig, bands, rows, k) for k, sig in signs]))
                low.append(bytes([signs[0][0]]) + signs[0][1].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["id", "n", "digest", "keys", "low"])


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, at = word_hashes(part.column("text"))
            sets = [np.unique(shingle_hashes(hashes[a:b], words)).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "set"])


def _confirm(top: int, of: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if of * min(len(a), len(b)) < top * max(len(a), len(b)):
                good.append(False)
                continue
            i = np.searchsorted(a, b)
            i[i == len(a)] = 0
            both = int(np.count_nonzero(a[i] == b))
            good.append(of * both >= top * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _alike(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Rows whose signatures agree in `least` places, or were thinned differently (the first place), so that they can't tell."""
    return (np.count_nonzero(a[:, 1:] == b[:, 1:], axis=1) >= least) | (a[:, 0] != b[:, 0])


def _agreeing(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("low_a", "low_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(_alike(a, b, least) if batch.num_rows else [], pa.bool_()))


def confirmed(pairs: DataFrame, signs: DataFrame, sets: DataFrame, least: int, top: int, of: int) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets have a Jaccard similarity of at least top / of; signatures that agree in fewer than `least` places spare their sets the way."""
    near = pairs.join(signs.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("low").alias("low_a")), "a").join(signs.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("low").alias("low_b")), "b")
    near = near.filter(of * F.least("n_a", "n_b") >= top * F.greatest("n_a", "n_b")).select("a", "b", "low_a", "low_b").mapInArrow(functools.partial(_agreeing, least), "a long, b long").distinct()
    met = near.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(functools.partial(_confirm, top, of), "a long, b long")


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = [np.unique(np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint32)).tobytes() for x in batch.column("set")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(short, pa.binary())], ["id", "short"])


def _likely(least: int, top: int, of: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group, of its two blocks or in one, that lie in different components and whose shortened sets are similar, give or take what shortening may change.

    A pair that meets in several buckets is looked at in the first one only; what isn't similar never leaves the task.
    """

    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        if of * min(len(a), len(b)) < top * max(len(a), len(b)) - 4 * of:
            return False
        i = np.searchsorted(a, b)
        i[i == len(a)] = 0
        both = int(np.count_nonzero(a[i] == b)) + 2
        return of * both >= top * (len(a) + len(b) - both)

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, part, block = (group.column(c).to_numpy() for c in ("id", "component", "block"))
        if len(ids) < 2 or (part == part[0]).all():
            return
        low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(len(ids), -1)
        lists = group.column("keys").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        keys = np.arange(len(ids))[:, None] * np.ones((1, sizes.max()), np.int64)  # beyond its own keys a row has nobody else's
        keys[np.arange(sizes.max()) < sizes[:, None]] = lists.flatten().to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("short")]
        key, first, second = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        found = []
        for i in left:
            other = right[(part[right] != part[i]) & ((ids[right] > ids[i]) | (first != second))]
            other = other[_alike(low[other], low[i : i + 1], least)]
            met = keys[other] == keys[i]
            apart = (sizes[other] != sizes[i]) | (low[other, 0] != low[i, 0])  # thinned differently: their common keys stand in other places
            other = other[apart | (keys[i][met.argmax(1)] == key)] if len(other) else other
            found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in other.tolist() if alike(sets[i], sets[j])]
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return by_group(batches, ["key", "i", "j"], work)


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, top: int = 75, of: int = 100, bands: int = BANDS, rows: int = ROWS, large: int = LARGE) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of documents.

    Linked are documents whose sets of `words`-word shingles (A-Z lower-cased; a shorter text is one shingle) have a Jaccard
    similarity of at least top / of. Texts without words, null ones too, have no shingles and no links. component_id is the
    smallest id reachable, kept marks that id's row. Rows that repeat an id are one document with several texts; a row with
    a null id stays by itself, with a null component, and is kept. Sets of more than `large` shingles are signed by a part of
    them that grows with the set, and compared whole like others.

    Equal sets meet by digest first, so only one row of a class of copies goes on. In each band's bucket all members are
    compared with one of them, on full sets, and components formed; buckets that hold several components are compared with other members,
    in ROUNDS rounds, which join most of what belongs together. Members of what remains in several components are
    compared across them, in blocks of BLOCK rows spread over tasks, by signature and by sets of shortened hashes; only pairs that
    are similar there leave a task, to be confirmed on full sets. So no pair of a bucket is left out, nor are all of them made.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    given = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = written(given.mapInArrow(functools.partial(_sign, words, bands, rows, large), "id long, n long, digest binary, keys array<long>, low binary"))
    named = signed.filter("id is not null and digest is not null")
    first = written(named.groupBy("digest").agg(F.min("id").alias("id")))
    copies = named.select("digest", F.col("id").alias("b")).distinct().join(first.withColumnRenamed("id", "a"), "digest").filter("a <> b").select("a", "b")
    # the rows that stand for a class: by digest and id, so a large class of copies isn't one key
    single = written(named.join(first, ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"]).drop("digest"))
    spread = single.select("id", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("id").alias("l"), F.max("id").alias("h")).filter("l <> h").select("key")
    hits = written(spread.join(shared, "key"))
    wanted = written(hits.select("id").distinct())
    signs = having(single.select("id", "n", "low"), wanted, "id")
    sets = written(having(given, wanted, "id").mapInArrow(functools.partial(_sets, words), "id long, set binary"))
    coordinates, share = bands * rows, top / of
    least = int(coordinates * share - DEVIATIONS * (coordinates * share * (1 - share)) ** 0.5)
    parts = hits.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    for turn in range(ROUNDS + 1):
        placed = written(hits.join(parts, hits["id"] == parts["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component")))
        mixed = written(placed.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("order"), "id", "component")).alias("hub")).filter("l <> h"))
        if turn < ROUNDS:
            pairs = placed.join(mixed.select("key", "hub"), "key").filter("component <> hub.component").select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        else:
            rest = placed.join(mixed.select("key"), "key")
            kept = written(rest.select("id").distinct())
            blocks = having(single.select("id", "n"), kept, "id").join(rest.select("key", "id"), "id").groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
            rest = rest.join(written(blocks), "key")
            short = having(sets, kept, "id").mapInArrow(_shortened, "id long, short binary")
            full = having(single.select("id", "low", "keys"), kept, "id").join(short, "id")
            rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
            rest = rest.select("key", "id", "component", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")).join(full, "id").select("key", "i", "j", "block", "id", "component", "low", "keys", "short")
            pairs = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(functools.partial(_likely, least, top, of), "a long, b long").distinct()
        # the forest of the rounds before stands for their links
        links = confirmed(pairs, signs, sets, least, top, of).union(parts.select("node", "component").toDF("a", "b"))
        parts = written(components(links.union(copies) if turn == ROUNDS else links))
    out = signed.select("id", "n").join(parts, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").cast(kind).alias(id_column), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
