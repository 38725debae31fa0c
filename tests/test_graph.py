"""The traversal's rules one by one on small graphs, and as a whole against plain Python on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import paths, traverse
from weft.plans import model, star
from weft.plans.model import EDGES, NODES, OMICS, GraphSpec, Relation


def graph(spark, nodes, edges):
    full = [(n + (None,) * 6)[:6] if isinstance(n, tuple) else (n, "gene", n, None, None, None) for n in nodes]
    return spark.createDataFrame(full, NODES), spark.createDataFrame([(e + (None,) * 5)[:5] for e in edges], EDGES)


def seeds(spark, *keys):
    return spark.createDataFrame([(k, k) for k in keys], "seed string, key string")


def test_conductance(spark):
    cases = [("REGULATES", 0.8, "literature", 0.4), ("REGULATES", 0.8, None, 0.8), ("REGULATES", None, None, 0.5), ("ASSOCIATED_WITH", 0.0, None, 0.4), ("ASSOCIATED_WITH", None, None, 0.4), ("ASSOCIATED_WITH", 5e-8, None, 0.24337), ("ASSOCIATED_WITH", 1e-30, None, 1.0), ("DIFFERENTIALLY_EXPRESSED", -2.0, None, 0.5), ("DIFFERENTIALLY_EXPRESSED", None, None, 0.25), ("GENE_DISEASE_ASSOC", 0.6, None, 0.8), ("GENE_DISEASE_ASSOC", None, None, 0.6), ("CATALYSES", None, None, 0.7), ("IMPLICATED_IN", None, "literature", 0.25)]
    df = spark.createDataFrame([(r, "a", "b", s, t) for r, s, t, _ in cases], EDGES).select(model.conductance(OMICS).alias("c"))
    assert [r.c for r in df.collect()] == pytest.approx([c for *_, c in cases], abs=1e-4)


def test_backbone_is_pinned_and_hubs_are_capped(spark):
    nodes = [("g", "gene"), ("t", "transcript"), ("p", "protein"), ("m", "metabolite", "ATP"), *[(f"v{i:03}", "variant") for i in range(60)], *[(f"q{i:02}", "protein") for i in range(12)]]
    edges = [("PRODUCES", "g", "t"), ("TRANSLATES_TO", "t", "p"), ("CATALYSES", "p", "m"), *[("IN_GENE", f"v{i:03}", "g") for i in range(60)], *[("INTERACTS_WITH", "p", f"q{i:02}", 0.95) for i in range(12)]]
    n, e = graph(spark, nodes, edges)
    kept, within = traverse.signal_decay(n, e, seeds(spark, "g", "nowhere"), OMICS, max_nodes=10)
    got = {r.key: r for r in kept.collect()}
    assert {"g", "t", "p", "m"} <= got.keys() and all(got[k].pinned for k in "gtpm") and len(got) == 10
    assert got["m"].signal == pytest.approx(1 * 0.7 * 0.9 * 0.7 * 1.0 * 0.7 * 0.7)
    kept, _ = traverse.signal_decay(n, e, seeds(spark, "g"), OMICS, max_nodes=300)
    keys = [r.key for r in kept.collect()]
    assert sorted(k for k in keys if k[0] == "v") == [f"v{i:03}" for i in range(10)] and sorted(k for k in keys if k[0] == "q") == [f"q{i:02}" for i in range(10)]
    assert traverse.signal_decay(n, e, seeds(spark, "nowhere"), OMICS)[0].count() == 0


def test_compartments_and_bridges(spark):
    nodes = [("a", "protein", "a", None, ["nucleus"]), ("b", "protein", "b", None, ["mitochondrion"]), ("c", "protein", "c", None, []), ("d", "protein", "d", None, ["nucleus", "x"])]
    n, e = graph(spark, nodes, [("INTERACTS_WITH", "a", x, 0.9) for x in "bcd"])
    assert {r.key for r in traverse.signal_decay(n, e, seeds(spark, "a"), OMICS, compartment_filter=True)[0].collect()} == {"a", "c", "d"}
    leaves = [("m1", 5, "citrate"), ("m2", 500, "x"), ("m3", None, "y"), ("m4", 1, " ATP ")]
    nodes = spark.createDataFrame([(k, "metabolite", name, None, None, d) for k, d, name in leaves], NODES)
    assert {r.key: r.b for r in nodes.select("key", traverse.bridges(OMICS).alias("b")).collect()} == {"m1": True, "m2": False, "m3": False, "m4": False}


def plain(nodes, edges, spec, seed, decay, floor, most):
    """Snapshot semantics in plain Python."""
    kind = {n[0]: n[1] for n in nodes}
    adj = {}
    for rel, s, t, score in edges:
        r = spec.relations[rel]
        cond = r.constant if r.constant is not None else min(1.0, score)
        for a, b in {(s, t), (t, s)}:
            adj.setdefault(a, []).append((b, rel, s, t, cond, 0.0 if r.constant is not None else score, r.cap, r.structural))
    state, rec, frontier, done = {seed: (1.0, True)}, set(), {seed}, set()
    for _ in range(4):
        new = [(b, state[a][0] * decay * c, (rel, s, t)) for a in frontier for b, rel, s, t, c, *_, st in adj.get(a, []) if st]
        done |= frontier
        for b, x, edge in new:
            rec.add(edge)
            state[b] = (max(x, state.get(b, (0, 0))[0]), True)
        frontier = {b for b, *_ in new} - done
    frontier, done = {seed}, set()
    for _ in range(8):
        if not frontier or len(state) >= most:
            break
        before, step = dict(state), []
        for a in frontier:
            groups = {}
            for edge in adj.get(a, []):
                groups.setdefault(edge[1], []).append(edge)
            for group in groups.values():
                group.sort(key=lambda g: (-g[5], g[0]))
                step += [(a, g) for g in group[: group[0][6] or len(group)]]
        done |= frontier
        nxt = set()
        for a, (b, rel, s, t, c, _, _, st) in step:
            x = before[a][0] * decay * c
            if x < floor:
                continue
            rec.add((rel, s, t))
            old = state.get(b, (0.0, False))
            state[b] = (max(old[0], x), old[1] or (st and before[a][1]))
            nxt.add(b)
        frontier = {b for b in nxt if b not in done and kind[b] != spec.leaf_kind}
    pinned = [k for k, v in state.items() if v[1]]
    rest = sorted((k for k, v in state.items() if not v[1]), key=lambda k: (-state[k][0], k))[: max(0, most - len(pinned))]
    keep = {*pinned, *rest}
    return {k: state[k] for k in keep}, {x for x in rec if x[1] in keep and x[2] in keep}


def test_random_graphs_against_plain_python(spark):
    spec = GraphSpec(relations={"S": Relation(constant=0.9, structural=True), "A": Relation(cap=2), "B": Relation(cap=3)}, leaf_kind="leaf")
    rng = random.Random(1)
    for _ in range(2):
        nodes = [(f"n{i:02}", rng.choice(["x", "x", "leaf"]), "n", None, None, None) for i in range(30)]
        pairs = {(rng.choice("SAABBB"), *rng.sample(range(30), 2)) for _ in range(70)}
        edges = [(r, f"n{a:02}", f"n{b:02}", rng.choice([0.2, 0.5, 0.9])) for r, a, b in sorted(pairs) if r != "S" or a % 5 == 0]
        n, e = graph(spark, nodes, edges)
        kept, within = traverse.signal_decay(n, e, seeds(spark, "n00", "n07"), spec, max_nodes=15)
        rows, links = kept.collect(), within.collect()
        for seed in ("n00", "n07"):
            state, rec = plain(nodes, edges, spec, seed, 0.7, 0.05, 15)
            assert {r.key: (round(r.signal, 9), r.pinned) for r in rows if r.seed == seed} == {k: (round(x, 9), pin) for k, (x, pin) in state.items()}
            assert {(r.rel, r.src, r.dst) for r in links if r.seed == seed} == rec


def test_components_and_paths(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [("x", "y")]
    e = spark.createDataFrame([("R", a, b) for a, b in chain], "rel string, src string, dst string")
    keys = spark.createDataFrame([(k,) for k in sorted({k for p in chain for k in p} | {"lonely"})], "key string")
    parts = {r.key: r.component for r in paths.connected_components(keys, e).collect()}
    assert parts["c20"] == "c00" and parts["y"] == "x" and parts["lonely"] == "lonely"
    for target, hops, quality in (("c02", 2, "direct"), ("c04", 4, "moderate"), ("c06", 6, "weak"), ("c07", None, "no_path")):
        path = paths.shortest_path(e, "c00", target)
        assert path.count() == (hops + 1 if hops else 0)
        assert path.agg(paths.path_quality(F.max("step")).alias("q")).first().q == quality
    assert paths.shortest_path(e, "x", "x").count() == 1


def test_rings_move_the_frontier_only(spark):
    """The stored adjacency of a prepared graph isn't shuffled, whatever way a ring joins it; it holds what the caps let through."""
    spec = GraphSpec(relations={"S": Relation(constant=0.9, structural=True), "A": Relation(cap=2), "B": Relation(cap=3)})
    nodes = [(f"n{i:02}", "x", "n", None, None, None) for i in range(40)]
    edges = [("A", "n00", f"n{i:02}", i / 40) for i in range(1, 30)] + [("S", "n00", f"n{i:02}", None) for i in range(30, 40)]
    prepared = traverse.prepare(*graph(spark, nodes, edges), spec)
    assert sorted((r.rel, r.to) for r in prepared.rings.filter("`from` = 'n00'").collect()) == [("A", "n28"), ("A", "n29"), *[("S", f"n{i}") for i in range(30, 40)]]
    frontier = spark.createDataFrame([("s", "n00", 1.0)], "seed string, from string, signal double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan(prepared.rings.join(F.broadcast(frontier), "from"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(prepared.rings.join(frontier.union(frontier), "from")).count("Exchange hash") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    again = traverse.walk(prepared, seeds(spark, "n00", "n29"))
    assert {(r.seed, r.key) for r in again[0].collect()} >= {("n00", "n28"), ("n00", "n29"), ("n29", "n00")}


def test_one_walk_prepares_nothing(spark, monkeypatch):
    """A walk that reads a graph once writes its edges once; what else it writes is near its seeds, however large the rest is."""
    nodes = [*[(f"n{i}", "x", "n") for i in range(400)], ("z", "x", "n")]
    edges = [("A", f"n{i}", f"n{i + 1}", 0.9) for i in range(399)] + [("A", "z", "n0", 0.9), ("S", "z", "n1")]
    spec, sizes, plain_write = GraphSpec(relations={"S": Relation(constant=0.9, structural=True), "A": Relation(cap=2)}), [], traverse.written
    n, e = graph(spark, nodes, edges)

    def counting(df, *rest):
        out = plain_write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(traverse, "written", counting)
    monkeypatch.setattr(traverse, "bucketed", counting)
    kept, _ = traverse.signal_decay(n, e, seeds(spark, "z"), spec, rings=2)
    assert {r.key for r in kept.collect()} == {"z", "n0", "n1", "n2"}
    assert sorted(sizes)[-1] == 401 and sorted(sizes)[-2] < 20


def test_capped_in_parts(spark, monkeypatch, tmp_path):
    """However many tasks deal with them, a hub's best edges are the same, and tasks follow the number of lines."""
    rows = [("hub", f"n{i:04d}", "r", float(i % 37), 5) for i in range(900)] + [(f"n{i:04d}", "hub", "r", 1.0, 5) for i in range(900)]
    df = spark.createDataFrame(rows, "from string, to string, rel string, rank double, cap int")
    once, dealt = (sorted(map(tuple, traverse.capped(df, ["from"], {5}, parts).collect())) for parts in (None, 7))
    assert once == dealt and len(once) == 905
    assert traverse.capped(df, ["from"], {5}, 7).rdd.getNumPartitions() >= 7
    spark.range(100).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(star, "PART", 30)
    assert star.parts(spark, str(tmp_path)) == 4
