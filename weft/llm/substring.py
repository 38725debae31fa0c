"""Passages that repeat across documents: compact windows of min-hashes, met on hashes, verified on shingles."""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import by_group, mix, shingle_hashes, slices, word_hashes, written

#: Words of a shingle and of the shortest passage, hash functions. A passage at 0.75 meets under none of three with probability 0.016, one at 0.8 with 0.008.
WORDS, LEAST, HASHES = 5, 50, 3
#: Rounds of comparing with one member of each group, before what is left is compared in pairs of blocks of so many members.
ROUNDS, MEMBERS = 2, 512
#: Pairs of members that are held against each other at once.
TOGETHER = 512
#: Shingles by which inserted and deleted words may move the two sides of a passage against each other around an anchor.
SHIFT = 16


def anchors(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Places that hold the least value of some window of `length` places of their document.

    A place's compact window (as far as values stay larger on both sides) is that long exactly if one such window has its
    minimum there. All windows at once: running minima by doubling, then the largest minimum of the windows over each place.
    """
    n = len(values)
    if n < length:
        return np.zeros(0, np.int64)

    def running(x: np.ndarray, op: np.ufunc) -> np.ndarray:
        size = 1
        while size * 2 <= length:
            x = op(x[:-size], x[size:])
            size *= 2
        return op(x[: n_out], x[length - size : length - size + n_out]) if size < length else x

    n_out = n - length + 1
    low = running(values, np.minimum)
    across = starts[1:-1]
    if len(across):  # windows that reach into the next document
        bad = np.zeros(n + 1, np.int32)
        np.add.at(bad, np.maximum(0, across - length + 1), 1)
        np.add.at(bad, across, -1)
        low[np.cumsum(bad)[:n_out] > 0] = 0
    padded = np.concatenate([np.zeros(length - 1, low.dtype), low, np.zeros(length - 1, low.dtype)])
    n_out = n
    return np.flatnonzero((running(padded, np.maximum) == values) & (values > 0))


def thinned(places: np.ndarray, values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Anchors without most of those that repeat a minimum within less than `length` places, as lines that repeat give them.

    Of a run of equal minima the first and last one in each half length stay, so each window still holds one that stays.
    """
    doc = np.searchsorted(starts, places, "right") - 1
    order = np.lexsort((places, values[places], doc))
    p, v, d = places[order], values[places[order]], doc[order]
    begins = np.ones(len(p), bool)
    begins[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1]) | (np.diff(p) >= length)
    origin = p[np.maximum.accumulate(np.where(begins, np.arange(len(p)), 0))] if len(p) else p
    first = begins.copy()
    first[1:] |= np.diff((p - origin) // (length // 2)) != 0
    last = np.ones(len(p), bool)
    last[:-1] = first[1:]
    return np.sort(p[first | last])


def extents(values: np.ndarray, places: np.ndarray, starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Compact windows of the anchors, as places before and behind each: its range in the Cartesian tree of its document's values
    (up to the next smaller value on either side), as far as `reach`."""
    before, after = np.zeros(len(places), np.int32), np.zeros(len(places), np.int32)
    padded = np.concatenate([np.zeros(reach, values.dtype), values, np.zeros(reach, values.dtype)])
    step = np.arange(1, reach + 1)
    doc = np.searchsorted(starts, places, "right") - 1
    for a in range(0, len(places), 1 << 14):
        at = places[a : a + (1 << 14)]
        own, d = values[at][:, None], doc[a : a + (1 << 14)]
        for out, sign, room in ((before, -1, at - starts[d]), (after, 1, starts[d + 1] - 1 - at)):
            smaller = padded[at[:, None] + reach + sign * step] < own
            far = np.where(smaller.any(1), smaller.argmax(1), reach)
            out[a : a + (1 << 14)] = np.minimum(far, room)
    return before, after


def _scan(least: int, count: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: each one's digest, its shingles as 32-bit numbers, and its compact windows, keyed by hash function and minimum."""
    length = least - WORDS + 1
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, at = word_hashes(part.column("text"))
            own = [shingle_hashes(hashes[a:b], WORDS) if b - a >= least else hashes[:0] for a, b in zip(at[:-1], at[1:], strict=True)]
            digests = [hashlib.blake2b(hashes[a:b].data, digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            shingles = np.concatenate(own) if own else hashes[:0]
            found = []
            for f in range(count if len(shingles) else 0):
                values = mix(shingles ^ np.uint64((f + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
                places = thinned(anchors(values, starts, length), values, starts, length)
                found.append((places, mix(values[places] + np.uint64(f)).view(np.int64), *extents(values, places, starts, length - 1 + SHIFT)))
            places, keys, before, after = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            doc = np.searchsorted(starts, places, "right") - 1
            order = np.argsort(doc, kind="stable")
            cut = pa.array(np.searchsorted(doc[order], np.arange(len(own) + 1)).astype(np.int32))
            fields = [pa.array(keys[order].astype(np.int64)), pa.array((places - starts[doc])[order].astype(np.int32)), pa.array(before[order]), pa.array(after[order])]
            windows = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(fields, ["key", "at", "before", "after"]))
            short = shingles.astype(np.uint32)
            seq = pa.array([short[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), pa.array(np.diff(at).astype(np.int64)), seq, windows], ["id", "digest", "words", "seq", "windows"])


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of b by shingle, then place, and for each place of a where its equals begin and end in there."""
    kept = np.sort(b.astype(np.uint64) << np.uint64(32) | np.arange(len(b), dtype=np.uint64))
    own = a.astype(np.uint64) << np.uint64(32)
    return kept, np.searchsorted(kept, own), np.searchsorted(kept, own | np.uint64(0xFFFFFFFF), "right")


def aligned(a: np.ndarray, b: np.ndarray, offset: int, met: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places i of a and j of b with equal shingles, both ascending, near the diagonal j = i + offset: a longest such chain,
    each i with its nearest j, so that inserted and deleted words move the diagonal instead of ending the passage."""
    kept, low, high = met or _met(a, b)
    i = np.flatnonzero(high > low)
    if not len(i):
        return i, i
    order, first, last = (kept & np.uint64(0xFFFFFFFF)).astype(np.int64), low[i], high[i] - 1
    j = order[first]
    if (last > first).any():  # of equal shingles in b (ascending places) the one nearest to the diagonal
        nearest = np.searchsorted(kept, a[i].astype(np.uint64) << np.uint64(32) | np.maximum(0, i + offset).astype(np.uint64))
        after, before = order[np.clip(nearest, first, last)], order[np.clip(nearest - 1, first, last)]
        j = np.where(np.abs(after - i - offset) < np.abs(before - i - offset), after, before)
    if (np.diff(j) > 0).all():
        return i, j
    tails: list[int] = []
    at: list[int] = []
    back = np.full(len(j), -1)
    for k, x in enumerate(j.tolist()):  # longest ascending chain
        t = bisect.bisect_left(tails, x)
        back[k] = at[t - 1] if t else -1
        if t == len(tails):
            tails.append(x)
            at.append(k)
        else:
            tails[t], at[t] = x, k
    chain, k = [], at[-1]
    while k >= 0:
        chain.append(k)
        k = back[k]
    return i[chain[::-1]], j[chain[::-1]]


def passages(a: np.ndarray, b: np.ndarray, length: int, top: int, of: int, offset: int = 0) -> list[tuple[int, int, int, int]]:
    """Near-duplicate ranges [s, e) of a and [s, e) of b, `length` shingles or more on both sides, that begin and end with
    equal shingles: multiset Jaccard of the two ranges, top / of at least, by their aligned shingles."""
    lo = max(0, -offset)
    n = min(len(a) - lo, len(b) - lo - offset)
    if n >= length:  # most copies: replaced words only, so that one diagonal holds all of the shorter range
        same = np.flatnonzero(a[lo : lo + n] == b[lo + offset : lo + offset + n])
        if len(same):
            s, e = int(same[0]), int(same[-1]) + 1
            if e - s >= length and e - s + SHIFT >= min(len(a), len(b)) and of * len(same) >= top * (2 * (e - s) - len(same)):
                return [(lo + s, lo + e, lo + offset + s, lo + offset + e)]
    kept, low, high = met = _met(a, b)
    there = np.flatnonzero(high > low)
    if len(there) < _needed(length, top, of):
        return []
    found = _aligned_passages(a, b, length, top, of, offset, met)
    if not found:
        values, first = np.unique(low[there], return_index=True)
        last = high[there[first]]
        if len(there) + (last - values).sum() > 2 * len(values):  # shingles repeat: other diagonals fit as well
            place = kept & np.uint64(0xFFFFFFFF)  # ascending within a shingle
            for k, here in ((0, place[values].min()), (-1, place[last - 1].max())):
                found = found or _aligned_passages(a, b, length, top, of, int(here) - int(there[k]), met)
    return found


def _needed(length: int, top: int, of: int) -> int:
    """Equal shingles of two shortest passages."""
    return -(-2 * length * top // (top + of))


def _aligned_passages(a: np.ndarray, b: np.ndarray, length: int, top: int, of: int, offset: int, met: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
    i, j = aligned(a, b, offset, met)
    if not len(i):
        return []
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(i)]]) - 1
    out: list[tuple[int, int, int, int]] = []
    reach = -1
    needed = _needed(length, top, of)
    for k in range(len(first)):
        if reach == len(first) - 1 or len(i) - first[k] < needed:
            break
        both = last[k:] - first[k] + 1
        m, n = i[last[k:]] - i[first[k]] + 1, j[last[k:]] - j[first[k]] + 1
        good = np.flatnonzero((m >= length) & (n >= length) & (of * both >= top * (m + n - both)))
        if len(good) and k + good[-1] > reach:
            reach = k + int(good[-1])
            out.append((int(i[first[k]]), int(i[last[reach]]) + 1, int(j[first[k]]), int(j[last[reach]]) + 1))
    return out


def _common(one: pa.Array, two: pa.Array) -> np.ndarray:
    """How many shingles, as multisets, the ranges of each row have in common: no chain of equal ones is longer."""
    sides = []
    for given in (one, two):
        given = given.cast(pa.large_binary())
        ends = np.frombuffer(given.buffers()[1], np.int64)[given.offset : given.offset + len(given) + 1] // 4
        key = np.frombuffer(given.buffers()[2], np.uint32)[ends[0] : ends[-1]].astype(np.uint64) | np.repeat(np.arange(len(given), dtype=np.uint64), np.diff(ends)) << np.uint64(32)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sides.append((key[first], np.diff(np.append(first, len(key)))))
    (x, n), (y, m) = sides
    if not len(x) or not len(y):
        return np.zeros(len(one))
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return np.bincount((x >> np.uint64(32)).astype(np.int64), np.where(y[at] == x, np.minimum(n, m[at]), 0), len(one))


def _verify(length: int, top: int, of: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        batch = batch.filter(pa.array(_common(batch.column("own"), batch.column("other")) >= _needed(length, top, of)))
        offsets = (batch.column("lo").to_numpy() - batch.column("delta").to_numpy() - batch.column("lo2").to_numpy()).tolist()
        for i, (x, y) in enumerate(zip(batch.column("own"), batch.column("other"), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            out += [(i, *p) for p in passages(a, b, length, top, of, offsets[i])]
        row, s, e, s2, e2 = np.array(out, np.int64).reshape(-1, 5).T
        take = pa.array(row)
        ids, hubs = batch.column("id").take(take), batch.column("hub").take(take)
        for own, other, begin, x, y in ((ids, hubs, "lo", s, e), (hubs, ids, "lo2", s2, e2)):
            lo = batch.column(begin).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([own, other, pa.array((x + lo).astype(np.int64)), pa.array((y + lo).astype(np.int64))], ["id", "other", "s", "e"])


def _numbered(near: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of some ranges and the range each is in; a range's k-th occurrence of a shingle differs from its first."""
    key = np.sort(np.concatenate(near).astype(np.uint64) | np.repeat(np.arange(len(near), dtype=np.uint64), [len(x) for x in near]) << np.uint64(32))
    v, r = key & np.uint64(0xFFFFFFFF), (key >> np.uint64(32)).astype(np.int64)
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(v))
    return v << np.uint64(16) | (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64), r


def _overlaps(x: list[np.ndarray], y: list[np.ndarray], open_x: np.ndarray, open_y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ranges, one of them open, that share `least` shingles (as multisets), and how many; of one list with itself each open one with all. Ranges that share fewer
    with all others together are left out first, in linear time."""
    same = x is y
    (u, ru) = _numbered(x)
    if same:
        v, rv = u, ru
        ordered = np.sort(u)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    else:
        v, rv = _numbered(y)
        shared = np.intersect1d(u, v)
    none = np.zeros(0, np.int64)
    if len(shared) < least:
        return none, none, none

    def part(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.searchsorted(shared, values)
        hit = place < len(shared)
        hit[hit] = shared[place[hit]] == values[hit]
        return place[hit], rows[hit], np.bincount(rows[hit], minlength=n) >= least

    sides = [part(u, ru, len(x))] * 2 if same else [part(u, ru, len(x)), part(v, rv, len(y))]
    kept = [sides[0][2] & open_x if same or not open_y.any() else sides[0][2], sides[1][2]]
    index = [np.flatnonzero(k) for k in kept]
    if not len(index[0]) or not len(index[1]):
        return none, none, none
    count = np.zeros((len(index[0]), len(index[1])), np.float32)
    for start in range(0, len(shared), 4096):
        parts = []
        for (place, rows, _), own, k in zip(sides, index, kept, strict=True):
            inside = k[rows] & (place >= start) & (place < start + 4096)
            side = np.zeros((len(own), min(4096, len(shared) - start)), np.float32)
            side[np.searchsorted(own, rows[inside]), place[inside] - start] = 1
            parts.append(side)
        count += parts[0] @ parts[1].T
    p, q = np.nonzero(count >= least)
    shares = count[p, q]
    p, q = index[0][p], index[1][q]
    good = open_x[p] | open_y[q]
    return p[good], q[good], shares[good]


def _placed(sides: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side the ranges as places among the shingles that are there at all (a row each, padded with the last place), and as a table
    of weights by place: 1 where a range has a shingle, -6 where it hasn't."""
    every = np.unique(np.concatenate([v for side in sides for v in side]))
    out = []
    for side in sides:
        lengths = np.array([len(v) for v in side])
        inside = np.arange(lengths.max()) < lengths[:, None]
        places = np.full(inside.shape, len(every), np.int64)
        places[inside] = np.searchsorted(every, np.concatenate(side))
        weights = np.full((len(side), len(every) + 1), -6, np.int16)
        weights[np.repeat(np.arange(len(side)), lengths), places[inside]] = 1
        weights[:, -1] = -6 * (lengths.max() + 1)
        out.append((places, weights))
    return out


def _long_enough(weights: np.ndarray, length: int) -> np.ndarray:
    """Rows with a run of at least `length` places that begins and ends with a weight of 1 and sums up to 0 or more."""
    if weights.shape[1] < length:
        return np.zeros(len(weights), bool)
    total = np.cumsum(weights, axis=1, dtype=np.int32)
    begins = np.where(weights == 1, total - weights, np.int32(1 << 30))
    least = np.minimum.accumulate(begins[:, : weights.shape[1] - length + 1], axis=1)
    return ((total[:, length - 1 :] >= least) & (weights[:, length - 1 :] == 1)).any(1)


def _alike(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may hold similar ranges: each range has 3 of 4 shingles in common with the other, the shorter one 6 of 7."""
    here = other[1][right[:, None], own[0][left]]
    good = _long_enough(np.maximum(here, -3), length)
    left, right, here = left[good], right[good], here[good]
    there = own[1][left[:, None], other[0][right]]
    good = _long_enough(np.where(there < -6, there, np.maximum(there, -3)), length)
    left, right, here, there = left[good], right[good], here[good], there[good]
    good = _long_enough(here, length) | _long_enough(there, length)
    return left[good], right[good]


def _pairs(least: int, length: int, top: int, of: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the members of two blocks of a group (without a second, of the first): for each one left over the passages that it shares
    with the first other member, most shared shingles first, that it shares one with. Pairs don't leave the task.

    Of two ranges with a similarity of 3/4 or more each has 3 of 4 shingles in common with the other, and the shorter one 6 of 7; members that have no such ranges are left out at once.
    """
    fields = ("id", "at", "lo", "open", "near")
    for batch in batches:
        same = batch.column("i").to_numpy() == batch.column("j").to_numpy()
        for k, (one, two) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
            sides = []
            for given in (one,) if same[k] else (one, two):
                m = {c: given.values.field(f) for f, c in enumerate(fields)}
                ids, at, lo = (m[c].to_numpy() for c in ("id", "at", "lo"))
                sides.append((ids, at - lo, lo, m["open"].to_numpy(zero_copy_only=False).copy(), [np.frombuffer(n.as_buffer(), np.uint32) for n in m["near"]]))
            if not (sides[0][3].any() or sides[-1][3].any()):
                continue
            p, q, shared = _overlaps(sides[0][4], sides[-1][4], sides[0][3], sides[-1][3], least)
            good = sides[0][0][p] != sides[-1][0][q]
            p, q, shared = p[good], q[good], shared[good]
            if not len(p):
                continue
            places = _placed([side[4] for side in sides])
            out = []
            for x, y, own, other, left, right in ((sides[0], sides[-1], places[0], places[-1], p, q), (sides[-1], sides[0], places[-1], places[0], q, p))[: 1 if same[k] else 2]:
                order = np.lexsort((-shared, left))
                left, right = left[order], right[order]
                first = np.append(np.flatnonzero(np.append(True, left[1:] != left[:-1])), len(left)) if len(left) else np.zeros(1, np.int64)
                c = 0
                while c < len(first) - 1:  # the partners of some members at a time
                    stop = max(c + 1, int(np.searchsorted(first, first[c] + TOGETHER, "right")) - 1)
                    part = slice(first[c], first[stop])
                    l, r = (v[part][x[3][left[part]]] for v in (left, right))
                    c = stop
                    if 4 * top >= 3 * of and len(l):
                        l, r = _alike(own, other, l, r, length)
                    for i, j in zip(l.tolist(), r.tolist(), strict=True):
                        if not x[3][i]:
                            continue
                        found = passages(x[4][i], y[4][j], length, top, of, int(y[1][j] - x[1][i]))
                        if found:
                            x[3][i] = y[3][j] = False
                            out += [(x[0][i], y[0][j], s + x[2][i], e + x[2][i]) for s, e, *_ in found] + [(y[0][j], x[0][i], s + y[2][j], e + y[2][j]) for *_, s, e in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(out, np.int64).T], ["id", "other", "s", "e"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each member's range, packed by group and bucket of shingles: a row for each of these in a batch."""
    for batch in batches:
        for part in slices(batch, "near", 1 << 22):
            own = [np.unique(np.frombuffer(x.as_buffer(), np.uint32)) for x in part.column("near")]
            row, shingle = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
            key, many, ids, at = (part.column(c).to_numpy() for c in ("key", "buckets", "id", "at"))
            bucket = (shingle % many[row].astype(np.uint32)).astype(np.int32)
            order = np.lexsort((bucket, key[row]))
            row, shingle, bucket = row[order], shingle[order], bucket[order]
            cuts = np.flatnonzero((np.diff(key[row]) != 0) | (np.diff(bucket) != 0)) + 1
            edges = np.concatenate([[0], cuts, [len(row)]])
            packed = [pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for values in (shingle, ids[row], at[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(key[row][edges[:-1]]), pa.array(bucket[edges[:-1]]), *packed], ["key", "bucket", "shingles", "ids", "ats"])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a bucket each member has that no other member of its group has."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        shingle, ids, at = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("shingles", np.uint32), ("ids", np.int64), ("ats", np.int32)))
        _, first, many = np.unique(shingle, return_index=True, return_counts=True)
        first = first[many == 1]
        if len(first):
            members, n = np.unique(np.stack([ids[first], at[first].astype(np.int64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), group.column("key")[0].as_py(), np.int64)), pa.array(members[0]), pa.array(members[1].astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "id", "at", "n"])

    return by_group(batches, ["key", "bucket"], work)


def _meet(met: DataFrame, length: int) -> DataFrame:
    """Ranges to verify, (id, hub, delta, lo, hi, lo2, hi2), from anchors that two documents share with their windows.

    Both windows are cut to what the other one reaches, and SHIFT more; those of one pair on neighbouring diagonals are joined.
    """
    before, after = F.least("before", "before2") + SHIFT, F.least("after", "after2") + SHIFT
    ends = [(F.col("at") - F.least("before", before)).alias("lo"), (F.col("at") + F.least("after", after)).alias("hi"), (F.col("at2") - F.least("before2", before)).alias("lo2"), (F.col("at2") + F.least("after2", after)).alias("hi2")]
    met = met.filter((F.col("id") != F.col("hub")) & (before + after + 1 - SHIFT >= length)).select("id", "hub", (F.col("at") - F.col("at2")).alias("delta"), *ends)
    met = met.filter((F.col("hi") - F.col("lo") + 1 >= length) & (F.col("hi2") - F.col("lo2") + 1 >= length))
    w = Window.partitionBy("id", "hub").orderBy("delta", "lo", "hi", "lo2", "hi2")
    far = F.col("delta") - F.lag("delta").over(w) > SHIFT
    met = met.withColumn("far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("island", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return met.groupBy("id", "hub", "island").agg(F.min("delta").alias("delta"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo2").alias("lo2"), F.max("hi2").alias("hi2")).drop("island")


def repeated(documents: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, top: int = 75, of: int = 100, hashes: int = HASHES, rounds: int = ROUNDS, members: int = MEMBERS) -> DataFrame:
    """(id, start_word, end_word, n_words, other_id): passages of at least `least` words that documents share, overlapping ones joined; end is exclusive, other_id the smallest document found to share a part of it.

    Words are A-Z lower-cased. Each text gives the compact windows of `hashes` min-hash functions over its five-word shingles:
    ranges that share one minimum, from a Cartesian tree, long enough to hold a passage. Windows meet by function and minimum:
    an exact repeat of `least` words does so for every function, one of Jaccard similarity J for each with probability J. In
    each group windows are cut to what both reach, neighbouring diagonals of a pair joined, and shingles aligned, inserted and
    deleted words included; passages begin and end with equal shingles and are kept with a similarity of top / of. Members
    meet one of their group first; what no passage covers tries another one, and after `rounds` of them all others, in pairs
    of blocks of about `members` inside tasks. Members of larger groups whose surroundings nobody in the group shares go before
    that, by counting. Equal texts go on as one, their copies get its passages and, from `least` words on, the whole text as one.

    Null, empty and shorter texts, and rows with a null id, return nothing. Rows that repeat an id are one document, whose texts don't repeat
    each other; an empty table gives an empty one.
    """
    kind, length = documents.schema[id_column].dataType.simpleString(), least - WORDS + 1
    given = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and text is not null")
    rows = given.mapInArrow(functools.partial(_scan, least, hashes), "id long, digest binary, words long, seq binary, windows array<struct<key:long,at:int,before:int,after:int>>")
    rows = written(rows.filter(F.col("words") >= least))
    named = rows.select("id", "digest", "words")
    classes = written(named.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.max("words").alias("words")))
    copies = written(named.join(classes.filter("rep <> last").select("digest", "rep"), "digest").filter("id <> rep").select("rep", "id").distinct())
    windows = rows.select("id", F.explode("windows").alias("w")).select("id", "w.*")
    shared = written(windows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("key"))
    hits = written(windows.join(shared, "key", "left_semi").join(copies.select("id").distinct(), "id", "left_anti"))
    at = ("id", "at", "before", "after")
    hubs = hits.groupBy("key").agg(*[F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("o"), *at)).alias(f"h{turn}") for turn in range(rounds)], F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"))
    hubs = written(hubs.filter("a <> b").drop("a", "b"))
    sequences = rows.select(F.col("id").alias("doc"), "seq")
    cut = lambda lo, hi: F.substring(F.col("seq"), F.col(lo) * 4 + 1, (F.col(hi) - F.col(lo) + 1) * 4)
    found, rest = None, hits
    for turn in range(rounds):
        hub = hubs.select("key", *[F.col(f"h{turn}.{c}").alias("hub" if c == "id" else f"{c}2") for c in at])
        met = written(_meet(rest.join(hub, "key"), length))
        own = met.join(sequences, F.col("id") == F.col("doc")).select(*met.columns, cut("lo", "hi").alias("own"))
        both = own.join(sequences, F.col("hub") == F.col("doc")).select("id", "hub", "delta", "lo", "lo2", "own", cut("lo2", "hi2").alias("other"))
        new = both.mapInArrow(functools.partial(_verify, length, top, of), "id long, other long, s long, e long").distinct()
        found = written(found.union(new) if found is not None else new)
        covered = merged(found).select(F.col("id").alias("i"), "s", "e")
        rest = written(rest.join(covered, (F.col("id") == F.col("i")) & (F.col("at") >= F.col("s")) & (F.col("at") < F.col("e")), "left_anti"))
    found = written(found.union(_among(hits, rest, hubs.select("key", "n").filter("n > 2"), sequences, length, top, of, members)))
    alike = classes.filter("rep <> last")
    whole = alike.select(F.col("rep").alias("id"), F.col("last").alias("other"), F.lit(0).cast("long").alias("s"), (F.col("words") - WORDS + 1).alias("e"))
    again = copies.join(found.withColumnRenamed("id", "rep"), "rep").select("id", "other", "s", "e")
    twins = copies.join(alike.select("rep", "words"), "rep").select("id", F.col("rep").alias("other"), F.lit(0).cast("long").alias("s"), (F.col("words") - WORDS + 1).alias("e"))
    out = merged(found.union(whole).union(again).union(twins))
    return out.select(F.col("id").cast(kind).alias(id_column), F.col("s").alias("start_word"), (F.col("e") + WORDS - 1).alias("end_word"), (F.col("e") + WORDS - 1 - F.col("s")).alias("n_words"), F.col("other").cast(kind).alias("other_id"))


def _among(hits: DataFrame, rest: DataFrame, sizes: DataFrame, sequences: DataFrame, length: int, top: int, of: int, members: int) -> DataFrame:
    """Passages, (id, other, s, e), that what is left of groups (key, n) shares with other members of its group, around their anchors."""
    least = -(-2 * length * top // (top + of)) - 2  # what two shortest passages share around an anchor, a little less for longer ones
    many = written(sizes.join(rest.select("key").distinct(), "key", "left_semi").select("key", F.ceil(F.col("n") / members).cast("int").alias("parts")))
    opened = rest.select("key", "id", "at", F.lit(True).alias("open"))
    near = hits.join(many, "key").join(sequences, F.col("id") == F.col("doc")).select("key", "parts", "id", "at", (F.col("at") - F.col("before")).alias("lo"), F.substring(F.col("seq"), (F.col("at") - F.col("before")) * 4 + 1, (F.col("before") + F.col("after") + 1) * 4).alias("near"))
    near = written(near.join(opened, ["key", "id", "at"], "left").withColumn("open", F.coalesce("open", F.lit(False))))
    large = near.filter("parts > 1")
    spread = large.select("key", "id", "at", F.ceil(F.col("parts") / 8).cast("int").alias("buckets"), "near").mapInArrow(_spread, "key long, bucket int, shingles binary, ids binary, ats binary")
    alone = spread.repartition("key", "bucket").sortWithinPartitions("key", "bucket").mapInArrow(_alone, "key long, id long, at int, n long")
    alone = alone.groupBy("key", "id", "at").agg(F.sum("n").alias("alone"))
    large = written(large.join(alone, ["key", "id", "at"], "left").filter(F.length("near") / 4 - F.coalesce("alone", F.lit(0)) >= least).drop("alone", "parts"))
    parts = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("parts"))

    def blocks(df: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "at"), "parts").cast("int").alias("block")
        return df.groupBy("key", block).agg(F.collect_list(F.struct("id", "at", "lo", "open", "near")).alias("a"), F.bool_or("open").alias("open"))

    whole = blocks(near.filter("parts = 1")).filter("open")
    dealt = written(blocks(large.join(parts, "key")))
    two = dealt.select("key", F.col("block").alias("i"), "a", "open").join(dealt.select("key", F.col("block").alias("j"), F.col("a").alias("b"), F.col("open").alias("open2")), "key").filter("i <= j and (open or open2)")
    pairs = whole.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "a", F.lit(None).cast(whole.schema["a"].dataType).alias("b")).union(two.select("key", "i", "j", "a", "b").repartition("key", "i", "j"))
    return pairs.select("i", "j", "a", "b").mapInArrow(functools.partial(_pairs, least, length, top, of), "id long, other long, s long, e long")


def merged(segments: DataFrame) -> DataFrame:
    """Overlapping segments (id, other, s, e) of an id joined into one."""
    w = Window.partitionBy("id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = segments.groupBy("id", "s", "e").agg(F.min("other").alias("other")).withColumn("new", F.when(reach >= F.col("s"), 0).otherwise(1))
    return marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("other").alias("other")).drop("island")
