"""Merging neighbourhoods, connected components and bounded shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from weft.scratch import written

MAX_HOPS = 6


def merge_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First wins, by seed, on a node's key and an edge's (src, rel, dst)."""
    one = lambda df, keys: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("seed"))).filter("_rn = 1").drop("_rn")
    return one(nodes, ["key"]), one(edges, ["src", "rel", "dst"])


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) of the ends of undirected edges between whole numbers; component is the smallest number reachable.

    Large-star and small-star steps in turn, each a grouped minimum and a join, until the edges stay as they are. Minima are written before
    they meet the edges, so that Spark may split a hub's. Edges of a node with itself don't count.
    """
    a, b = edges.columns
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mark = Observation()
        edges = written(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct().observe(mark, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        now = mark.get["n"], mark.get["h"]
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now


def connected_components(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, component): component is the smallest key reachable over undirected edges (src, dst) between `keys`; ends that are no key count for nothing.

    Keys get numbers, so rounds move numbers only; the smallest key of a component is looked up at the end.
    """
    numbers = written(keys.select("key").filter("key is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    known = lambda side: numbers.select(F.col("key").alias(side), F.col("id").alias(f"{side}_id"))
    linked = edges.select("src", "dst").join(known("src"), "src").join(known("dst"), "dst").select("src_id", "dst_id")
    parts = stars(linked)
    of = numbers.join(parts, numbers["id"] == parts["node"], "left").select("key", F.coalesce("component", "id").alias("c"))
    least = of.groupBy("c").agg(F.min("key").alias("component"))
    return of.join(least, "c").select("key", "component")


def path_quality(hops: F.Column) -> F.Column:
    return F.when(hops.isNull(), "no_path").when(hops <= 2, "direct").when(hops <= 4, "moderate").otherwise("weak")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """One shortest undirected path for each of `pairs` (pair, source, target) as (pair, step, key, rel), rel leading to the key; no rows if there is none in max_hops (1 to 6).

    Breadth first from both ends of all pairs at once: a level is one join with the edges, so six hops are three. Of equally short paths
    the one with the smallest keys (then relations) backwards from the target. Steps keep all parents in tables; the ways from where both
    sides meet are found by joins with these. A pair that is found, or has a null end, isn't followed further.
    """
    hops = max(1, min(max_hops, MAX_HOPS))
    both = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel")).distinct())
    given = written(pairs.select("pair", "source", "target").filter("source is not null and target is not null").distinct())
    end = lambda side, column: given.select("pair", F.lit(side).alias("side"), F.col(column).alias("key"), F.lit(0).alias("level"))
    visited = written(end("f", "source").unionByName(end("b", "target")))
    steps, meets = [], None
    for level in range((hops + 1) // 2 + 1):
        at = lambda side, name: visited.filter(F.col("side") == side).select("pair", "key", F.col("level").alias(name))
        meets = written(at("f", "lf").join(at("b", "lb"), ["pair", "key"]).groupBy("pair").agg(F.min(F.col("lf") + F.col("lb")).alias("d")).filter(F.col("d") <= hops))
        frontier = visited.filter(F.col("level") == level).join(meets.select("pair"), "pair", "left_anti")
        if level == (hops + 1) // 2 or frontier.isEmpty():
            break
        step = frontier.select("pair", "side", F.col("key").alias("a")).join(both, "a").join(visited.select("pair", "side", F.col("key").alias("b")), ["pair", "side", "b"], "left_anti")
        steps.append(written(step.select("pair", "side", F.col("b").alias("key"), F.col("a").alias("parent"), "rel", F.lit(level + 1).alias("level"))))
        visited = written(visited.unionByName(steps[-1].select("pair", "side", "key", "level").distinct()))
    return _traced(given, visited, steps, meets)


def _traced(given: DataFrame, visited: DataFrame, steps: list[DataFrame], meets: DataFrame) -> DataFrame:
    """The path of each pair in `meets`: from the target to where the sides meet over nodes that lead there, then by the forward side's smallest parents."""
    half = F.floor(F.col("d") / 2).cast("int")
    at = lambda side, name: visited.filter(F.col("side") == side).select("pair", "key", F.col("level").alias(name))
    middle = written(at("f", "lf").join(at("b", "lb"), ["pair", "key"]).join(meets, "pair").filter((F.col("lb") == half) & (F.col("lf") == F.col("d") - half)).select("pair", "key", F.col("lb").alias("level")))
    leads, reached = [], middle.limit(0)
    for level in range(len(steps), 0, -1):
        here = middle.filter(F.col("level") == level).select("pair", "key").unionByName(reached.select("pair", "key")).distinct()
        edges = steps[level - 1].filter("side = 'b'").join(here, ["pair", "key"])
        leads.insert(0, written(edges.select("pair", "key", "parent", "rel")))
        reached = leads[0].select("pair", F.col("parent").alias("key")).distinct()
    now = written(given.join(meets, "pair").select("pair", F.col("target").alias("key"), F.col("d").alias("step"), half.alias("left")))
    out = None
    for edges in leads:  # one step towards the source while the backward side lasts
        own = now.filter("left > 0").join(edges.select("pair", F.col("parent").alias("key"), F.struct(F.col("key").alias("to"), "rel").alias("way")), ["pair", "key"])
        own = written(own.groupBy("pair", "key", "step", "left").agg(F.min("way").alias("way")))
        one = own.select("pair", "step", "key", F.col("way.rel").alias("rel"))
        out = one if out is None else out.unionByName(one)
        now = written(now.filter("left = 0").unionByName(own.select("pair", F.col("way.to").alias("key"), (F.col("step") - 1).alias("step"), (F.col("left") - 1).alias("left"))))
    for level in range(len(steps), 0, -1):
        edges = steps[level - 1].filter("side = 'f'").groupBy("pair", "key").agg(F.min(F.struct(F.col("parent").alias("to"), "rel")).alias("way"))
        own = written(now.filter(F.col("step") == level).join(edges, ["pair", "key"]))
        one = own.select("pair", "step", "key", F.col("way.rel").alias("rel"))
        out = one if out is None else out.unionByName(one)
        now = written(now.filter(F.col("step") != level).unionByName(own.select("pair", F.col("way.to").alias("key"), (F.col("step") - 1).alias("step"), "left")))
    first = now.filter("step = 0").select("pair", "step", "key", F.lit(None).cast("string").alias("rel"))
    return first if out is None else out.unionByName(first)


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """The path of one pair as (step, key, rel), see `shortest_paths`."""
    one = edges.sparkSession.createDataFrame([(0, source, target)], "pair long, source string, target string")
    return shortest_paths(one, edges, max_hops).drop("pair").orderBy("step")


def seed_clusters(components: DataFrame, seeds: DataFrame) -> DataFrame:
    """How many components the seeds lie in, and whether that is more than one."""
    hit = components.join(seeds.select("key").distinct(), "key", "left_semi")
    return hit.agg(F.countDistinct("component").alias("clusters")).withColumn("disconnected", F.col("clusters") > 1)
