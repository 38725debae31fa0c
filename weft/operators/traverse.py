"""The signal-decay neighbourhood: rings of expansions with per-node caps, a guaranteed backbone and a trim."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from weft.plans.model import GraphSpec, adjacency, compatible
from weft.scratch import bucketed, written

MAX_RINGS, BACKBONE_HOPS = 8, 4
#: Rows of a frontier, and of the edges that it meets, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def capped(candidates: DataFrame, group: list[str], caps: set[int], parts: int | None = None) -> DataFrame:
    """Of each group's edges of one relation the best `cap` (rank down, neighbour up); relations without a cap pass.

    Ranks are first held against the largest cap: with a constant bound Spark limits groups before the shuffle, so a hub's
    edges don't all travel. `parts`: tasks that edges are dealt to, a hub's by their neighbour before its best ones meet.
    """
    if not caps:
        return candidates.filter("cap is null")
    order = Window.partitionBy(*group, "rel").orderBy(F.desc("rank"), "to")
    given = candidates.filter("cap is not null")
    if parts and parts > 1:
        part = Window.partitionBy(*group, "rel", "_part").orderBy(F.desc("rank"), "to")
        dealt = given.withColumn("_part", F.pmod(F.xxhash64("to"), F.lit(parts))).repartition(parts, *group, "rel", "_part")
        given = dealt.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= max(caps)).drop("_part", "_rn").repartition(parts, *group, "rel")
    ranked = given.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max(caps))
    return candidates.filter("cap is null").unionByName(ranked.filter(F.col("_rn") <= F.col("cap")).drop("_rn"))


def bridges(spec: GraphSpec) -> F.Column:
    """Whether a leaf may pass a walk on: few neighbours, a known number of them, and not one of the names that are everywhere."""
    named = F.lower(F.trim(F.coalesce("name", F.lit("")))).isin(*sorted(spec.never_bridge)) if spec.never_bridge else F.lit(False)
    return F.coalesce((F.col("degree") <= spec.bridge_degree) & ~named, F.lit(False))


@dataclass(frozen=True)
class Prepared:
    """A graph as walks read it, written once for many walks. bones: edges of structural relations, leaves: edges of the leaf relation, both in both
    orientations; rings: of each node's edges those that its caps let through, with what a walk asks of the neighbour. If `stored` is false,
    rings are all edges, and a walk applies caps and looks up neighbours for the nodes that it comes to."""

    bones: DataFrame
    leaves: DataFrame
    rings: DataFrame
    nodes: DataFrame
    spec: GraphSpec
    bridge: bool
    stored: bool = True


def _caps(spec: GraphSpec, bridge: bool) -> set[int]:
    return {r.cap for r in spec.relations.values() if r.cap} | ({spec.bridge_cap} if bridge else set())


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`df`, written, and its number of rows."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def _of(df: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """Rows whose `column` is among the n rows of `keys`: where these are broadcast, no other row of `df` is shuffled."""
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, column, "left_semi")


def prepare(nodes: DataFrame, edges: DataFrame, spec: GraphSpec, bridge: bool = False, buckets: int | None = None) -> Prepared:
    """Writes what walks read. A cap keeps the best edges of a node whatever the walk, so it is applied here, once; a hub's capped edges are cut before they
    are shuffled. `rings` lies in buckets by the node that an edge leaves from, so a ring's join moves the frontier only."""
    adj = adjacency(edges, spec, bridge)
    structural = [name for name, r in spec.relations.items() if r.structural]
    side = adj.filter(F.col("rel").isin(*structural, spec.leaf_relation or ""))
    side = written(side.select("from", "to", "rel", "src", "dst", "cond"))
    known = written(nodes.select("key", "kind", "name", "locs", "degree"))
    to = known.select(F.col("key").alias("to"), F.col("kind").alias("to_kind"), F.col("locs").alias("to_locs"), "degree", "name")
    n = buckets or int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rings = bucketed(capped(adj, ["from"], _caps(spec, bridge)).drop("rank", "cap").join(to, "to"), n, "from")
    return Prepared(side.filter(F.col("rel").isin(*structural)), side.filter(F.col("rel") == (spec.leaf_relation or "")), rings, known, spec, bridge)


def signal_decay(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, spec: GraphSpec, decay: float = 0.7, min_signal: float = 0.05, max_nodes: int = 300, compartment_filter: bool = False, bridge: bool = False, rings: int = MAX_RINGS) -> tuple[DataFrame, DataFrame]:
    """`walk` for one call: edges are written once as they are, and every step takes from them what its frontier meets, so neither both orientations nor
    neighbours are shuffled for the whole graph. Nodes are written if the walk asks for more than their kinds."""
    asked = ["key", "kind", *(["locs"] if compartment_filter else []), *(["degree", "name"] if bridge else [])]
    known = written(nodes.select(*asked)) if len(asked) > 2 else nodes.select(*asked)
    adj = adjacency(written(edges.select("rel", "src", "dst", "score", "tier")), spec, bridge)
    structural = [name for name, r in spec.relations.items() if r.structural]
    graph = Prepared(adj.filter(F.col("rel").isin(*structural)), adj.filter(F.col("rel") == (spec.leaf_relation or "")), adj, known, spec, bridge, stored=False)
    return walk(graph, seeds, decay, min_signal, max_nodes, compartment_filter, rings)


def _ring(graph: Prepared, frontier: DataFrame, n: int) -> DataFrame:
    """What `prepare` writes as rings, for the nodes of the frontier only."""
    near, m = _counted(capped(_of(graph.rings, "from", frontier.select("from"), n), ["from"], _caps(graph.spec, graph.bridge)).drop("rank", "cap"))
    names = {"key": "to", "kind": "to_kind", "locs": "to_locs"}
    to = graph.nodes.select(*[F.col(c).alias(names.get(c, c)) for c in graph.nodes.columns])
    return (F.broadcast(near) if m <= BROADCAST_ROWS else near).join(to, "to")


def walk(graph: Prepared, seeds: DataFrame, decay: float = 0.7, min_signal: float = 0.05, max_nodes: int = 300, compartment_filter: bool = False, rings: int = MAX_RINGS) -> tuple[DataFrame, DataFrame]:
    """Neighbourhoods of all `seeds` (seed, key) at once: nodes (seed, key, kind, signal, pinned) and edges (seed, rel, src, dst).

    All seeds expand together, one join a ring. A ring reads the signals that held when it began. The backbone follows structural
    relations, without cap or floor, and attaches leaves to their hosts; what it reaches is pinned. Rings then expand all relations:
    cap, decay, floor, compartments; the next frontier is what was never expanded, without leaves that don't bridge. At the
    end pinned nodes stay and others by signal, up to max_nodes for each seed.

    A ring writes the open frontier, the edges that it follows, and the state (signals, what is expanded and what comes next), and counts rows as it writes them.
    """
    spec, known = graph.spec, graph.nodes
    steps: list[DataFrame] = []

    def put(df: DataFrame) -> tuple[DataFrame, int]:
        """The state, written, and how many of its rows are the next frontier."""
        seen = Observation()
        out = written(df.observe(seen, F.count_if("front").alias("n")))
        return out, seen.get["n"]

    def merged(state: DataFrame, step: DataFrame, pinned: Column, front: Column) -> tuple[DataFrame, int]:
        new = step.select("seed", F.col("to").alias("key"), F.col("new").alias("signal"), pinned.alias("pinned"), F.lit(False).alias("done"), front.alias("front"))
        old = state.select("seed", "key", "signal", "pinned", (F.col("done") | F.col("front")).alias("done"), F.lit(False).alias("front"))
        both = old.unionByName(new).groupBy("seed", "key").agg(F.max("signal").alias("signal"), F.bool_or("pinned").alias("pinned"), F.bool_or("done").alias("done"), F.bool_or("front").alias("front"))
        return put(both.withColumn("front", F.col("front") & ~F.col("done")))

    def followed(frontier: DataFrame, n: int, over: DataFrame) -> DataFrame:
        met = over.join(F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier, "from")
        return met.withColumn("new", F.col("signal") * decay * F.col("cond"))

    def record(step: DataFrame) -> DataFrame:
        steps.append(step.select("seed", "rel", "src", "dst"))
        return step

    yes = F.lit(True)
    asked, n = _counted(seeds.select("seed", "key").distinct())
    found = asked.join(_of(known.select("key"), "key", asked.select("key"), n).distinct(), "key", "left_semi")
    state, n = put(found.select("seed", "key", F.lit(1.0).alias("signal"), yes.alias("pinned"), F.lit(False).alias("done"), yes.alias("front")))
    found = state.select("seed", "key")
    structural = [name for name, r in spec.relations.items() if r.structural]
    if structural:
        for _ in range(BACKBONE_HOPS):
            if not n:
                break
            frontier = state.filter("front").select("seed", F.col("key").alias("from"), "signal")
            step = record(written(followed(frontier, n, _of(graph.bones, "from", frontier.select("from"), n))))
            state, n = merged(state, step, yes, yes)
    if spec.leaf_relation:
        hosts, n = _counted(state.join(known.filter(F.col("kind") == spec.leaf_host).select("key"), "key", "left_semi").select("seed", F.col("key").alias("from"), "signal"))
        leaves = _of(graph.leaves, "from", hosts.select("from"), n).join(known.filter(F.col("kind") == spec.leaf_kind).select(F.col("key").alias("to")), "to", "left_semi")
        order = Window.partitionBy("from").orderBy("to")
        leaves = followed(hosts, n, leaves.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= spec.leaf_cap))
        state, _ = merged(state, record(written(leaves)), yes, F.lit(False))

    state = state.select("seed", "key", "signal", "pinned", F.lit(False).alias("done")).join(F.broadcast(found.withColumn("front", yes)), ["seed", "key"], "left").withColumn("front", F.coalesce("front", F.lit(False)))
    state, n = put(state)
    for _ in range(rings):
        if not n:
            break
        open_seeds = state.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < max_nodes).select("seed")
        frontier, n = _counted(state.filter("front").join(F.broadcast(open_seeds), "seed", "left_semi").select("seed", F.col("key").alias("from"), "signal", "pinned"))
        if not n:
            break
        step = followed(frontier, n, graph.rings if graph.stored else _ring(graph, frontier, n)).filter(F.col("new") >= min_signal)
        if compartment_filter:
            own = _of(known.select(F.col("key").alias("from"), F.col("locs").alias("from_locs")), "from", frontier.select("from"), n)
            step = step.join(own, "from", "left").filter(~F.col("compartments") | compatible(F.col("from_locs"), F.col("to_locs")))
        step = record(written(step.drop("to_locs")))
        passes = yes if spec.leaf_kind is None else (F.col("to_kind") != spec.leaf_kind) | (bridges(spec) if graph.bridge else F.lit(False))
        state, n = merged(state, step, F.col("structural") & F.col("pinned"), passes)

    trim = Window.partitionBy("seed", "pinned").orderBy(F.desc("signal"), "key")
    pins = Window.partitionBy("seed")
    kept = state.withColumn("rn", F.row_number().over(trim)).withColumn("np", F.sum(F.col("pinned").cast("int")).over(pins)).filter(F.col("pinned") | (F.col("rn") <= max_nodes - F.col("np")))
    kept, n = _counted(kept.select("seed", "key", "signal", "pinned"))
    recorded = steps[0] if steps else graph.rings.select(F.lit("").alias("seed"), "rel", "src", "dst").limit(0)
    for step in steps[1:]:
        recorded = recorded.unionByName(step)
    within = recorded.distinct().join(kept.select("seed", F.col("key").alias("src")), ["seed", "src"], "left_semi").join(kept.select("seed", F.col("key").alias("dst")), ["seed", "dst"], "left_semi")
    if compartment_filter:
        tied = [name for name, r in spec.relations.items() if r.compartments]
        own = _of(known.select("key", "locs"), "key", kept.select("key"), n)
        ends = within.join(own.select(F.col("key").alias("src"), F.col("locs").alias("a")), "src", "left").join(own.select(F.col("key").alias("dst"), F.col("locs").alias("b")), "dst", "left")
        within = ends.filter(~F.col("rel").isin(*tied) | compatible(F.col("a"), F.col("b")))
    kept = F.broadcast(kept) if n <= BROADCAST_ROWS else kept
    return kept.join(known.select("key", "kind"), "key").select("seed", "key", "kind", "signal", "pinned"), within.select("seed", "rel", "src", "dst")
