"""Many shortest paths at once against a plain breadth-first search."""

import random

import pytest

from weft.operators import paths


def plain(edges, source, target, hops):
    """The path of the breadth-first search that gives each node its smallest parent, read from the target."""
    near = {}
    for rel, a, b in edges:
        near.setdefault(a, []).append((b, rel))
        near.setdefault(b, []).append((a, rel))
    level, parent, frontier = {source: 0}, {}, [source]
    for h in range(1, hops + 1):
        new = {}
        for a in frontier:
            for b, rel in near.get(a, []):
                if b not in level:
                    new[b] = min(new.get(b, (a, rel)), (a, rel))
        for b, p in new.items():
            level[b], parent[b] = h, p
        frontier = list(new)
    if target not in level:
        return []
    out, at = [], target
    while at != source:
        out.append((level[at], at, parent[at][1]))
        at = parent[at][0]
    return [(0, source, None), *out[::-1]]


@pytest.mark.parametrize("hops", [6, 5, 1])
def test_many_pairs(spark, hops):
    rng = random.Random(hops)
    keys = [f"n{i:03d}" for i in range(400)]
    edges = [(rng.choice("RS"), *rng.sample(keys, 2)) for _ in range(520)]
    pairs = [(i, rng.choice(keys), rng.choice(keys)) for i in range(1000)]
    odd = [(1000, keys[0], keys[0]), (1001, "nobody", keys[1]), (1002, "nobody", "nobody"), (1003, None, keys[1]), (5, *pairs[5][1:])]
    e = spark.createDataFrame(edges, "rel string, src string, dst string")
    got = {}
    for r in paths.shortest_paths(spark.createDataFrame(pairs + odd, "pair long, source string, target string"), e, hops).collect():
        got.setdefault(r.pair, []).append((r.step, r.key, r.rel))
    expected = {i: p for i, a, b in pairs + odd[:3] if (p := plain(edges, a, b, hops))}
    assert {i: sorted(p, key=lambda x: x[0]) for i, p in got.items()} == expected
    assert hops < 5 or {len(p) - 1 for p in expected.values()} >= set(range(hops + 1))


def test_few_joins_with_the_edges(spark, monkeypatch):
    """Six hops read the edges three times, whatever the number of pairs."""
    chain = [("R", f"c{i}", f"c{i + 1}") for i in range(6)]
    e = spark.createDataFrame(chain, "rel string, src string, dst string")
    sizes = []
    keep = paths.written
    monkeypatch.setattr(paths, "written", lambda df: (sizes.append(set(df.columns)), keep(df))[1])
    pairs = spark.createDataFrame([(i, "c0", "c6") for i in range(50)], "pair long, source string, target string")
    assert paths.shortest_paths(pairs, e).count() == 350
    assert sum("parent" in c and "level" in c for c in sizes) == 3
    assert paths.shortest_paths(pairs.limit(0), e).count() == 0 and paths.shortest_paths(pairs, e.limit(0)).count() == 0
