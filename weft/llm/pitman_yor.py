"""Language-model scores of documents: a hierarchical Pitman-Yor model of word pairs, seated by Gibbs sampling.

Restaurants: one for each context (the word before, or the end of a document), all with one parent, the restaurant of single
words, whose own base is uniform over the vocabulary and one unknown word. Words are told apart by hashes: half of one deals them into slices, the other half tells them apart there. Their ids
are dense, so tables of words are slices of arrays; counts of pairs lie in buckets by a hash of the pair, so a hot context or pair is spread or counted before it travels.
Everything numeric travels packed.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import lexicon
from weft.llm.common import mix
from weft.llm.lexicon import packed, unpacked
from weft.scratch import bucketed, written

#: ASCII characters of words: all but white space.
SOLID = bytes(b for b in range(128) if b not in b" \t\n\v\f\r")
UNKNOWN = 0
CHUNK_BYTES = 12 << 20
#: Tokens for each bucket of pairs, bytes of text for each slice of words, owners whose parts of a slice meet in one group.
BUCKET_TOKENS, SLICE_BYTES, FAN = 3_000_000, 32 << 20, 64
#: The customers of dishes with more than this are seated all at once.
SMALL = 128
#: Concentrations to choose from.
GRID = tuple(10 ** (k / 4) for k in range(-8, 25))


# Seating -----------------------------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithms of the gamma function of positive numbers (Stirling's series from 10 on)."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for k in range(10):
        low += np.log(x + k)
    y = x + 10
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _customers(c: np.ndarray, base: np.ndarray, slope: np.ndarray, d: float, sweeps: int, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after one seating in sequence and `sweeps` of Gibbs sampling, a customer of every dish at a time."""
    order = np.argsort(-c, kind="stable")
    c, base, slope = c[order], base[order], slope[order]
    first = np.cumsum(c) - c
    table, size, free = np.zeros(c.sum(), np.int64), np.zeros(c.sum(), np.int64), np.zeros(c.sum(), np.int64)
    tables, spare = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    active = np.searchsorted(-c, -np.arange(c.max(initial=0)), "left")
    for sweep in range(sweeps + 1):
        for j, k in enumerate(active.tolist()):
            own, others = first[:k] + j, np.full(k, j) if sweep == 0 else c[:k] - 1
            if sweep:
                left = table[own]
                size[left] -= 1
                gone = np.flatnonzero(size[left] == 0)
                tables[gone] -= 1
                free[first[gone] + spare[gone]] = left[gone]
                spare[gone] += 1
            new_mass = base[:k] + slope[:k] * tables[:k]
            opens = rng.random(k) * (new_mass + others - d * tables[:k]) < new_mass
            opens |= tables[:k] == 0
            new = np.flatnonzero(opens)
            if sweep:
                spare[new] -= 1
                place = free[first[new] + spare[new]]
            else:
                place = own[new]
            table[own[new]] = place
            size[place] = 1
            tables[new] += 1
            rest = np.flatnonzero(~opens)
            while len(rest):  # a table by its size less d: that of a random other customer, taken with chance (size - d) / size
                i = (rng.random(len(rest)) * others[rest]).astype(np.int64)
                if sweep:
                    i += i >= j
                to = table[first[rest] + i]
                taken = rng.random(len(rest)) * size[to] < size[to] - d
                table[own[rest[taken]]] = to[taken]
                size[to[taken]] += 1
                rest = rest[~taken]
        if sweep == 0:
            empty = np.flatnonzero(size == 0)
            dish = np.searchsorted(first, empty, "right") - 1
            spare = np.bincount(dish, minlength=len(c)).astype(np.int64)
            free[first[dish] + np.arange(len(empty)) - (np.cumsum(spare) - spare)[dish]] = empty
    out = np.zeros(len(c), np.int64)
    out[order] = tables
    return out


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of the weights of all arrangements of c customers at t tables (generalised Stirling numbers), by a saddle point of their generating function."""
    t = np.minimum(t, c - 0.16)
    low, high = np.full(np.broadcast(c, t).shape, -700.0), np.full(np.broadcast(c, t).shape, -1e-12)
    for _ in range(50):  # log of 1 - x where t * x * f'(x) / f(x) = c, f(x) = (1 - (1 - x) ** d) / d
        y = (low + high) / 2
        more = -np.expm1(d * y) * np.exp((1 - d) * y) / (-d * np.expm1(y)) * c > t
        low, high = np.where(more, low, y), np.where(more, y, high)
    y = (low + high) / 2
    x, f = -np.expm1(y), -np.expm1(d * y) / d
    slope = x * np.exp((d - 1) * y) / f
    bend = t * slope * (1 - slope - (d - 1) * x * np.exp(-y))
    return lgamma(c + 1.0) - lgamma(t + 1.0) + t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(bend, 1e-12))


def _tables(c: np.ndarray, base: np.ndarray, slope: np.ndarray, d: float, rng: np.random.Generator, points: int = 33) -> np.ndarray:
    """Tables of dishes with many customers, drawn at once from their distribution given everything else, on a grid around its mode."""
    odds = lambda t: log_stirling(c[:, None], t, d) + _log_rising_by(base[:, None], slope[:, None], t)
    low, high = np.zeros(len(c)), np.log(c)
    for step in range(12):  # the mode in log t, each turn between the neighbours of the best of nine points
        grid = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, 9)
        best = odds(np.exp(grid)).argmax(1)
        low, high = (np.take_along_axis(grid, np.clip(best + k, 0, 8)[:, None], 1)[:, 0] for k in (-1, 1))
        if step >= 3 and (np.exp(high) - np.exp(low) < np.maximum(1, np.exp(low / 2) / 2)).all():
            break
    mode = np.rint(np.exp((low + high) / 2))
    wide = np.maximum(1, np.rint(np.sqrt(mode) / 4))
    t = mode[:, None] + wide[:, None] * (np.arange(points) - points // 2)
    inside = (t >= 1) & (t <= c[:, None])
    p = np.where(inside, odds(np.clip(t, 1, c[:, None])), -np.inf)
    p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
    pick = (p < rng.random(len(c))[:, None] * p[:, -1:]).sum(1)
    drawn = np.take_along_axis(t, np.minimum(pick, points - 1)[:, None], 1)[:, 0] + np.rint((rng.random(len(c)) - 0.5) * (wide - 1))
    return np.clip(drawn, 1, c).astype(np.int64)


def _log_rising_by(base: np.ndarray, slope: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log of base * (base + slope) * ... of t factors."""
    x = base / slope
    near = x < 1e8  # beyond, all factors are base
    x = np.where(near, x, 1.0)
    return np.where(near, t * np.log(slope) + lgamma(x + t) - lgamma(x), t * np.log(base))


def seat(c: np.ndarray, base: np.ndarray, slope: np.ndarray, d: float, sweeps: int, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables for dishes with c customers each, where a new table weighs base + slope * tables and an old one its customers less d."""
    out = np.ones(len(c), np.int64)
    some, many = np.flatnonzero((c > 1) & (c <= SMALL)), np.flatnonzero(c > SMALL)
    if len(some):
        out[some] = _customers(c[some], base[some], slope[some], d, sweeps, rng)
    if len(many):
        out[many] = _tables(c[many], base[many], slope[many], d, rng)
    return out


# Chunks of documents -----------------------------------------------------------------------------------------------


def _read(slices: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk (key: its number): its documents and their words as codes; and one for each slice that has some of its words (key -1 - slice): their hashes and training counts, in the order of codes."""
    for chunk, docs, at, codes, vocabulary in lexicon.chunks(functools.partial(lexicon.words, solid=SOLID), "text", CHUNK_BYTES, batches):
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, vocabulary.to_pylist())), "<u8").reshape(-1, 2)
        spot = (hashes[:, 1] % np.uint64(slices)).astype(np.int64)
        order = np.lexsort((hashes[:, 0], spot))
        code = np.empty(len(order), np.int64)
        code[order] = np.arange(len(order))
        codes, hashes, spot = code[codes], hashes[order, 0], spot[order]
        held = docs.column("held_out").combine_chunks()
        n = np.bincount(codes[np.repeat(~held.to_numpy(zero_copy_only=False), np.diff(at))], minlength=len(order))
        some, counts = _distinct(spot)
        end = np.cumsum(counts)
        sent = [(-1 - k, chunk, packed(np.diff(hashes[a:b], prepend=np.uint64(0))), packed(n[a:b])) for k, a, b in zip(some.tolist(), end - counts, end, strict=True)]
        keys, chunks, first, second = zip((chunk, chunk, packed(codes), packed(np.bincount(spot, minlength=slices))), *sent, strict=True)
        lists = [docs.column("id").combine_chunks(), held, pa.array(np.diff(at))]
        columns = [pa.array(keys), pa.array(chunks), pa.array(first, pa.binary()), pa.array(second, pa.binary())]
        columns += [pa.ListArray.from_arrays(pa.array([0, *[len(x)] * len(keys)], pa.int32()), x) for x in lists]
        yield pa.RecordBatch.from_arrays(columns, ["key", "chunk", "a", "b", "ids", "held_out", "sizes"])
        pa.default_memory_pool().release_unused()


WORDS = "slice long, chunk long, data binary, size long, total long"


def _number(sent: pa.Table) -> pa.Table:
    """A slice's words that occur in training, by hash: their counts (chunk -1), and for each chunk the places of its words among them, from 1, or 0."""
    slice_, n = -1 - sent.column("key")[0].as_py(), sent.num_rows
    hashes = [np.cumsum(unpacked(x).view(np.uint64)) for x in sent.column("a").to_pylist()]
    every, where = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(where, np.concatenate([unpacked(x) for x in sent.column("b").to_pylist()]), len(every)).astype(np.int64)
    place = np.where(c > 0, np.cumsum(c > 0), 0)[where]
    end = np.cumsum([len(h) for h in hashes])
    data = [packed(c[c > 0]), *[packed(place[b - len(h) : b]) for h, b in zip(hashes, end, strict=True)]]
    chunk = [-1, *sent.column("chunk").to_pylist()]
    return pa.table([pa.array([slice_] * (n + 1)), pa.array(chunk), pa.array(data, pa.binary()), pa.array([int((c > 0).sum()), *[0] * n]), pa.array([int(c.sum()), *[0] * n])], ["slice", "chunk", "data", "size", "total"])


def _ids(starts: np.ndarray, end: int, counts: bytes, places: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk's words by code, and of the end token behind them; where each slice's words begin."""
    first = np.concatenate([[0], np.cumsum(unpacked(counts))])
    ids = np.zeros(first[-1] + 1, np.int64)
    ids[-1] = end
    for k, place in places.items():
        ids[first[k] : first[k + 1]] = np.where(place > 0, starts[k] + place - 1, UNKNOWN)
    return ids, first


def _tokens(codes: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """All tokens of the documents as codes: each document's words and then an end (code `words`)."""
    tokens = np.full(len(codes) + len(sizes), words, np.int32 if words < 1 << 31 else np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = codes
    return tokens


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often they occur."""
    keys = np.sort(keys)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys)))


def _pair_keys(tokens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the key of the pair with the one before (an end before a document's first), and whether both are known words."""
    keys, known = tokens.astype(np.int64), (ids != UNKNOWN)[tokens]
    both = known.copy()
    keys[1:] += tokens[:-1].astype(np.int64) * len(ids)
    both[1:] &= known[:-1]
    if len(keys):
        keys[0] += (len(ids) - 1) * len(ids)
        both[0] &= ids[-1] != UNKNOWN
    return keys, both


def _buckets(keys: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of both words of each pair, its bucket, and the order of pairs by ids."""
    u, w = ids[keys // len(ids)], ids[keys % len(ids)]
    bucket = (mix(mix(u.view(np.uint64)) + w.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    return u, w, bucket, np.argsort(_joined(u, w))


def _by(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group's number and the places of its members in their order."""
    order = np.argsort(groups, kind="stable")
    some, counts = _distinct(groups)
    end = np.cumsum(counts)
    for g, a, b in zip(some.tolist(), end - counts, end, strict=True):
        yield g, order[a:b]


SENT = "key long, chunk long, u binary, w binary, n binary"


def _send(starts: np.ndarray, end: int, buckets: int, parts: pa.Table, back: pa.Table) -> pa.Table:
    """What a chunk sends to each bucket: its pairs of known words in order (differences of the first ids), with their training counts."""
    rows = []
    places = {k: unpacked(x) for k, x in zip(back.column("slice").to_pylist(), back.column("data").to_pylist(), strict=True)}
    for row in parts.select(["chunk", "held_out", "sizes", "a", "b"]).to_pylist():
        ids, _ = _ids(starts, end, row["b"], places)
        sizes = np.array(row["sizes"], np.int64)
        keys, both = _pair_keys(_tokens(unpacked(row["a"]), sizes, len(ids) - 1), ids)
        held = np.repeat(np.array(row["held_out"], bool), sizes + 1)
        learned, counts = _distinct(keys[both & ~held])
        wanted, _ = _distinct(np.concatenate([learned, keys[both & held]]))
        del keys, both, held
        n = np.zeros(len(wanted), np.int64)
        n[np.searchsorted(wanted, learned)] = counts
        u, w, bucket, order = _buckets(wanted, ids, buckets)
        for b, at in _by(bucket[order]):
            at = order[at]
            rows.append((b, row["chunk"], packed(np.diff(u[at], prepend=0)), packed(w[at]), packed(n[at])))
    pa.default_memory_pool().release_unused()
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["key", "chunk", "u", "w", "n"])


# Pairs of a bucket -------------------------------------------------------------------------------------------------


def _joined(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Both ids of pairs as one number."""
    if max(u.max(initial=0), w.max(initial=0)) >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")
    return u << 31 | w


def _merge(sent: pa.Table) -> pa.Table:
    """A bucket's pairs: those seen once (u1, w1) and those seen more often (u2, w2, c2), each sorted; how many were seen once and twice."""
    keys = np.concatenate([_joined(np.cumsum(unpacked(u)), unpacked(w)) for u, w in zip(sent.column("u").to_pylist(), sent.column("w").to_pylist(), strict=True)])
    n = np.concatenate([unpacked(x) for x in sent.column("n").to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    keys, c = keys[first], np.add.reduceat(n, np.flatnonzero(first)) if len(n) else n
    one, many = keys[c == 1], keys[c > 1]
    low = (1 << 31) - 1
    data = [one >> 31, one & low, many >> 31, many & low, c[c > 1]]
    return pa.table([pa.array([sent.column("key")[0].as_py()]), *[pa.array([packed(x)], pa.binary()) for x in data], pa.array([int((c == 1).sum())]), pa.array([int((c == 2).sum())])], ["key", "u1", "w1", "u2", "w2", "c2", "ones", "twos"])


def _places(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ids that a bucket's pairs need, in order."""
    return _distinct(np.concatenate([u, w]))[0]


def _spread(starts: np.ndarray, key: int, u: np.ndarray, w: np.ndarray, t: np.ndarray) -> list[tuple]:
    """A bucket's tables by word, as context and as dish, a row for each slice."""
    ids = _places(u, w)
    as_context = np.bincount(np.searchsorted(ids, u), t, len(ids)).astype(np.int64)
    as_dish = np.bincount(np.searchsorted(ids, w), t, len(ids)).astype(np.int64)
    return [(key, k, packed(ids[at] - starts[k]), packed(as_context[at]), packed(as_dish[at])) for k, at in _by(np.searchsorted(starts, ids, "right") - 1)]


ROUND = "key long, slice long, ids binary, a binary, b binary"


def _rounds(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["key", "slice", "ids", "a", "b"])


def _start(starts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the first round each pair has one table. Pairs seen once keep that: their tables (slice under -1) never change."""
    for batch in batches:
        for row in batch.to_pylist():
            u, w = unpacked(row["u2"]), unpacked(row["w2"])
            one_u, one_w = unpacked(row["u1"]), unpacked(row["w1"])
            t = np.ones(len(u), np.int64)
            rows = [(row["key"], -1, None, packed(t), packed(np.zeros(len(u), np.int64))), *_spread(starts, row["key"], u, w, t)]
            rows += [(k, -2 - s, ids, a, b) for k, s, ids, a, b in _spread(starts, row["key"], one_u, one_w, np.ones(len(one_u), np.int64))]
            yield from _rounds(rows).to_batches()


def _sample(starts: np.ndarray, scale: dict, keep: bool, number: int, sweeps: int, seed: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """One round in a bucket: seats the customers of its pairs, given the words' tables and the parent's probabilities of the last exchange."""
    out = []
    for row in left.to_pylist():
        key, u, w, c = row["key"], *(unpacked(row[x]) for x in ("u2", "w2", "c2"))
        ids = _places(u, w)
        contexts, chance = np.zeros(len(ids)), np.zeros(len(ids))
        t = total = None
        for r in right.to_pylist():
            if r["slice"] == -1:
                t, total = unpacked(r["values"][0]), unpacked(r["values"][1])
            else:
                at = np.searchsorted(ids, unpacked(r["ids"]) + starts[r["slice"]])
                contexts[at] = unpacked(r["values"][1])
                chance[at] = _parent(scale, unpacked(r["values"][2]), unpacked(r["values"][3]))
        p = chance[np.searchsorted(ids, w)]
        base = (scale["theta"] + scale["d"] * (contexts[np.searchsorted(ids, u)] - t)) * p
        t = seat(c, np.maximum(base, 1e-300), scale["d"] * p, scale["d"], sweeps, np.random.default_rng([seed, number, key]))
        out += [(key, -1, None, packed(t), packed(total + t * keep)), *_spread(starts, key, u, w, t)]
    return _rounds(out)


def _parent(scale: dict, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Probabilities of words in the restaurant of single words."""
    return (customers - scale["d0"] * tables + (scale["theta0"] + scale["d0"] * scale["tables0"]) * scale["base"]) / (scale["theta0"] + scale["customers0"])


# Words by slice ----------------------------------------------------------------------------------------------------


def _add(rows: pa.Table) -> pa.Table:
    """Sums of the parts of one slice."""
    ids, where = np.unique(np.concatenate([unpacked(x) for x in rows.column("ids").to_pylist()]), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([unpacked(x) for x in rows.column(c).to_pylist()]), len(ids)).astype(np.int64) for c in ("a", "b")]
    return pa.table([rows.column("key").slice(0, 1), rows.column("slice").slice(0, 1), *[pa.array([packed(x)], pa.binary()) for x in (ids, *sums)]], ["key", "slice", "ids", "a", "b"])


def _summed(spread: DataFrame, owners: int) -> DataFrame:
    """One row for each slice: parts are added up in a tree, at most FAN in a group."""
    while True:
        owners = -(-owners // FAN)
        spread = spread.withColumn("key", F.col("key") % owners).groupBy("slice", "key").applyInArrow(_add, ROUND)
        if owners == 1:
            return spread


def _log_rising(theta: np.ndarray, d: float, n: np.ndarray) -> np.ndarray:
    """log of theta * (theta + d) * ... of n factors, for every theta (rows)."""
    x = theta[:, None] / d
    return n * math.log(d) + lgamma(x + n) - lgamma(x)


def _words(scale: dict, number: int, sweeps: int, seed: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """A slice's words: count, tables as a context, customers and tables in the parent restaurant, seated anew; and sums that the driver needs."""
    (row,) = left.to_pylist()
    c = unpacked(row["c"])
    contexts, customers, tables = (np.zeros(len(c), np.int64) for _ in range(3))
    for r in right.to_pylist():
        at = unpacked(r["ids"])
        contexts[at] += unpacked(r["a"])
        customers[at] += unpacked(r["b"])
    some = np.flatnonzero(customers)
    mass = np.full(len(some), (scale["theta0"] + scale["d0"] * scale["tables0"]) * scale["base"])
    tables[some] = seat(customers[some], mass, np.full(len(some), scale["d0"] * scale["base"]), scale["d0"], sweeps, np.random.default_rng([seed, number, row["slice"], 1]))
    theta = np.array(GRID)
    sizes, times = _distinct(c)
    fit = -(_log_rising(theta, 1.0, sizes) * times).sum(1)
    sizes, times = _distinct(contexts)
    fit += (_log_rising(theta, scale["d"], sizes) * times).sum(1)
    values = pa.array([[packed(x) for x in (c, contexts, customers, tables)]], pa.list_(pa.binary()))
    sums = pa.array([[float(customers.sum()), float(tables.sum()), float((customers == 1).sum()), float((customers == 2).sum()), *fit]], pa.list_(pa.float64()))
    return pa.table({"slice": pa.array([row["slice"]]), "values": values, "sums": sums})


def _look(left: pa.Table, right: pa.Table) -> pa.Table:
    """Values of the words that each owner asks of one slice."""
    held = [unpacked(x) for x in right.column("values")[0].as_py()] if right.num_rows else []
    rows = [[packed(h[at]) for h in held] for at in map(unpacked, left.column("ids").to_pylist())] if held else []
    kept = left.slice(0, len(rows))
    return pa.table([*[kept.column(c) for c in ("key", "slice", "ids")], pa.array(rows, pa.list_(pa.binary()))], ["key", "slice", "ids", "values"])


ANSWER = "key long, slice long, ids binary, values array<binary>"


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of a chunk's known words in a slice, from 0."""
    for batch in batches:
        places = [unpacked(x) for x in batch.column("data").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("slice"), pa.array([packed(x[x > 0] - 1) for x in places], pa.binary())], ["key", "slice", "ids"])


def _answers(asked: DataFrame, words: DataFrame, owners: int) -> DataFrame:
    """Answers to (key, slice, ids) out of (slice, values), at most about FAN owners of a slice in a group; a slice is copied to each."""
    salts = -(-owners // FAN)
    spots = asked.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    copies = words.select(F.col("slice"), "values", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return spots.groupBy("slice", "salt").cogroup(copies.groupBy("slice", "salt")).applyInArrow(_look, ANSWER)


# Scores ------------------------------------------------------------------------------------------------------------


def _values(scale: dict, kept: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """For each message of a bucket its pairs' customers less d for each table, averaged over samples; 0 for unseen pairs."""
    keys, values = np.zeros(1, np.int64), np.zeros(1)
    for row in right.to_pylist():
        one = _joined(unpacked(row["u1"]), unpacked(row["w1"]))
        many = _joined(unpacked(row["u2"]), unpacked(row["w2"]))
        keys = np.concatenate([keys, one, many])
        values = np.concatenate([values, np.full(len(one), 1 - scale["d"]), unpacked(row["c2"]) - scale["d"] / kept * unpacked(row["total"])])
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    out = []
    for row in left.to_pylist():
        asked = _joined(np.cumsum(unpacked(row["u"])), unpacked(row["w"]))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        out.append(pa.compress(np.where(keys[at] == asked, values[at], 0.0).astype("<f4").tobytes(), codec="zstd", asbytes=True))
    return pa.table([left.column("chunk"), left.column("key"), pa.array(out, pa.binary())], ["chunk", "key", "pairs"])


RESULT = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _score(starts: np.ndarray, scale: dict, samples: list[dict], ended: list[int], buckets: int, end: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """Scores of one chunk's documents. ended: the values of the end token."""
    ids_of, held = (left.column(x).combine_chunks().flatten() for x in ("ids", "held_out"))
    pairs, values = {}, {}
    for r in right.to_pylist():
        if r["pairs"] is not None:
            pairs[r["bucket"]] = r["pairs"]
        else:
            values.setdefault(r["slice"], {"values": None}).update({k: r[k] for k in ("data", "values") if r[k] is not None})
    for row in left.select(["chunk", "sizes", "a", "b"]).to_pylist():
        ids, first = _ids(starts, end, row["b"], {k: unpacked(v["data"]) for k, v in values.items()})
        size = len(ids) - 1
        table = np.zeros((1 + 3 * len(samples), size + 1))
        table[:, -1] = [ended[0], *[ended[4 * k + 1 + i] for k in range(len(samples)) for i in range(3)]]
        for k, v in values.items():
            at = first[k] + np.flatnonzero(unpacked(v["data"]))
            got = [unpacked(x) for x in v["values"] or []] or [np.zeros(0)] * 4 * len(samples)
            table[0, at] = got[0]
            for j in range(len(samples)):
                for i in range(3):
                    table[1 + 3 * j + i, at] = got[4 * j + 1 + i]
        sizes = np.array(row["sizes"], np.int64)
        tokens = _tokens(unpacked(row["a"]), sizes, size)
        keys, both = _pair_keys(tokens, ids)
        wanted, _ = _distinct(keys[both])
        *_, bucket, order = _buckets(wanted, ids, buckets)
        seen = np.zeros(len(wanted))
        for b, at in _by(bucket[order]):
            seen[order[at]] = np.frombuffer(pa.decompress(pairs[b], 4 * len(at), codec="zstd", asbytes=True), "<f4")
        del bucket, order, pairs
        p = np.zeros(len(tokens))
        p[both] = seen[np.searchsorted(wanted, keys[both])]
        del keys, both, wanted, seen
        c = table[0]
        before = np.concatenate([np.full(min(1, len(tokens)), size, tokens.dtype), tokens[:-1]])
        p /= (scale["theta"] + c)[before]
        for j, s in enumerate(samples):
            back = (scale["theta"] + scale["d"] * table[1 + 3 * j]) / (scale["theta"] + c)
            p += back[before] * (_parent(s, table[2 + 3 * j], table[3 + 3 * j]) / len(samples))[tokens]
        first = np.cumsum(sizes + 1) - sizes - 1
        per = lambda x: np.add.reduceat(x, first)
        base = np.log10((c + 1) / (scale["n"] + scale["v"] + 1))
        columns = [ids_of, held, pa.array(sizes + 1), pa.array(per((c > 0).astype(np.int64)[tokens])), pa.array(np.full(len(sizes), scale["n"])), pa.array(per(base[tokens])), pa.array(per(np.log10(p)))]
        pa.default_memory_pool().release_unused()
        return pa.table(columns, RESULT)
    return pa.table([ids_of, *[pa.array([], t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]], RESULT)


def _root(scale: dict, sums: np.ndarray) -> dict:
    """What is known of the parent restaurant after its seating; its discount and concentration are fitted to it."""
    customers, tables, ones, twos = sums[:4]
    d0 = _discount(ones, twos)
    theta = np.array(GRID)
    fit = _log_rising(theta, d0, np.array([tables]))[:, 0] - _log_rising(theta, 1.0, np.array([customers]))[:, 0]
    return scale | {"d0": d0, "theta0": float(theta[fit.argmax()]), "customers0": float(customers), "tables0": float(tables)}


def _discount(ones: float, twos: float) -> float:
    return float(min(0.95, max(0.05, ones / max(1.0, ones + 2 * twos))))


def held_out(id_column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 7 == 2, F.lit(False))


def score(documents: DataFrame, id_column: str = "doc_id", text: str = "text", rounds: int = 4, kept: int = 2, sweeps: int = 2, seed: int = 13) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of documents.

    Words are lower-cased (A-Z) runs between white space, each document ends in an end token, which is also the context of its first word.
    Learns from all documents whose crc32(id as text) mod 7 isn't 2; a null id's count is learned. A round seats the customers of all
    pairs given the parent's probabilities, in sequence and then by `sweeps` of Gibbs sampling, then exchanges tables by word and seats the
    parent's customers. The last `kept` rounds' predictive probabilities are averaged. Dishes with more than SMALL customers are blocks
    of that sampling: their number of tables is drawn from its distribution given everything else. The discount is fitted to counts of ones and twos, concentrations to the seatings.
    perplexity is 10 ** (-sum of scores / sum of tokens). score: log10 of a probability, pairs' counts in single precision.
    A null or empty text is one end token; unknown words get the parent's mass of a new one; repeated rows are learned and scored each;
    without anything to learn from every token has probability 1 over an empty vocabulary, so scores are 0.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_column].dataType.simpleString()
    given = documents.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text).cast("string").alias("text"))
    docs, learned, size = (x or 0 for x in given.agg(F.count(F.lit(1)), F.count_if(~F.col("held_out")), F.sum(F.octet_length("text"))).first())
    slices, shards = 1 + size // SLICE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = given.mapInArrow(functools.partial(_read, slices), f"key long, chunk long, a binary, b binary, ids array<{kind}>, held_out array<boolean>, sizes array<long>")
    read = bucketed(read, shards, "key")
    parts = read.filter("key >= 0")
    numbers = written(read.filter("key < 0").select("key", "chunk", "a", "b").groupBy("key").applyInArrow(_number, WORDS))
    own = numbers.filter("chunk = -1")
    starts = np.ones(slices + 2, np.int64)
    total = 0
    for r in own.select("slice", "size", "total").collect():  # one row for SLICE_BYTES of text
        starts[r["slice"] + 1] += r["size"]
        total += r["total"]
    starts = np.cumsum(starts) - np.arange(len(starts))
    words_known, end = int(starts[slices]) - 1, int(starts[slices]) if learned else UNKNOWN
    starts[slices + 1] = starts[slices] + 1
    starts = starts[:-1]
    v = words_known + (learned > 0)
    scale = {"n": total + learned, "v": v, "base": 1 / (v + 1), "d": 0.5, "theta": 1.0, "d0": 0.5, "theta0": 1.0, "customers0": 0.0, "tables0": 0.0}
    add = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    chunks, tokens = (x or 0 for x in parts.agg(F.count(F.lit(1)), F.sum(add)).first())
    buckets = max(1, -(-(tokens + docs) // BUCKET_TOKENS))

    back = numbers.filter("chunk >= 0").select("chunk", "slice", "data")
    sent = parts.select("key", "chunk", "held_out", "sizes", "a", "b").groupBy("key").cogroup(back.withColumnRenamed("chunk", "key").groupBy("key"))
    messages = bucketed(sent.applyInArrow(functools.partial(_send, starts, end, buckets), SENT), buckets, "key")
    pairs = bucketed(messages.groupBy("key").applyInArrow(_merge, "key long, u1 binary, w1 binary, u2 binary, w2 binary, c2 binary, ones long, twos long"), buckets, "key", dealt=True)
    scale["d"] = _discount(*(float(x or 0) for x in pairs.agg(F.sum("ones"), F.sum("twos")).first()))

    ended = spark.createDataFrame([(slices, packed(np.array([learned])))] if learned else [], "slice long, c binary")
    counts = written(own.select("slice", F.col("data").alias("c")).union(ended))
    state = bucketed(pairs.select("key", "u1", "w1", "u2", "w2").mapInArrow(functools.partial(_start, starts), ROUND), buckets, "key", dealt=True)
    once = written(_summed(state.filter("slice < -1").withColumn("slice", -2 - F.col("slice")), buckets))

    def exchange(number: int) -> DataFrame:
        """Words after a round: their tables summed over buckets, the parent seated."""
        sums = _summed(state.filter("slice >= 0"), buckets).union(once)
        words = counts.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(functools.partial(_words, scale, number, sweeps, seed), "slice long, values array<binary>, sums array<double>")
        return written(words)

    def fitted(words: DataFrame) -> np.ndarray:
        """Sums over all slices: as many numbers as GRID has, and four."""
        row = words.agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(4 + len(GRID))]).first()
        return np.array([x or 0.0 for x in row])

    words, samples, held = exchange(0), [], []
    for number in range(1, rounds + 1):
        sums = fitted(words)
        if number <= rounds - kept + 1:
            scale["theta"] = GRID[int(sums[4:].argmax())]
        scale = _root(scale, sums)
        heard = _answers(state.filter("slice >= 0").select("key", "slice", "ids"), words.select("slice", "values"), buckets)
        own = state.filter("slice = -1").select("key", "slice", "ids", F.array("a", "b").alias("values"))
        drawn = pairs.select("key", "u2", "w2", "c2").groupBy("key").cogroup(heard.union(own).groupBy("key")).applyInArrow(functools.partial(_sample, starts, scale, number > rounds - kept, number, sweeps, seed), ROUND)
        state = bucketed(drawn, buckets, "key", dealt=True)
        words = exchange(number)
        if number > rounds - kept:
            samples.append(_root(scale, fitted(words)))
            held.append(words)

    final = state.filter("slice = -1").select("key", F.col("b").alias("total"))
    seen = messages.select("key", "chunk", "u", "w").groupBy("key").cogroup(pairs.join(final, "key").groupBy("key")).applyInArrow(functools.partial(_values, scale, kept), "chunk long, key long, pairs binary")
    values = held[0].select("slice", "values")
    for other in held[1:]:
        values = values.join(other.select("slice", F.col("values").alias("_more")), "slice").select("slice", F.concat("values", "_more").alias("values"))
    last = values.filter(F.col("slice") == slices).select("values").first()
    last = [int(unpacked(bytes(x))[0]) for x in last[0]] if last else [0] * 4 * kept
    asked = back.mapInArrow(_known, "key long, slice long, ids binary")
    heard = _answers(asked, values, chunks).select(F.col("key").alias("chunk"), "slice", "values")
    heard = heard.unionByName(back, allowMissingColumns=True).unionByName(seen, allowMissingColumns=True).withColumnRenamed("key", "bucket")
    heard = heard.select(F.col("chunk").alias("key"), "bucket", "slice", "values", "data", "pairs")
    scored = parts.groupBy("key").cogroup(heard.groupBy("key"))
    scored = scored.applyInArrow(functools.partial(_score, starts, scale, samples, last, buckets, end), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_column)
