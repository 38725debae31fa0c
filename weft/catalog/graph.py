"""Queries of the graph operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import neighbourhood, paths, traverse, upsert
from weft.plans import star
from weft.plans.model import adjacency, compatible

SEEDS = ["S:1", "S:7", "C:5", "O:11"]


def _seeds(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k, k) for k in keys], "seed string, key string")


def _walk(spark: SparkSession, sf_dir: str, keys: list[str], **options) -> tuple[DataFrame, DataFrame]:
    return traverse.signal_decay(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), _seeds(spark, keys), star.SPEC, **options)


def walk_sql(keys: list[str], what: str, rings: int = traverse.MAX_RINGS, max_nodes: int = 300, compartment_filter: bool = False, bridge: bool = False) -> str:
    """The traversal for fixed seeds, its rings unrolled into common table expressions."""
    q = [star.SQL]
    leaf_cap = "cap" if not bridge else "case when rel = 'SUPPLIER_PART' then 25 else cap end"
    q.append("s0 as (select k as seed, k as key, 1.0::double as signal, true as pinned from (values " + ", ".join(f"('{k}')" for k in keys) + ") v(k) where k in (select key from star_nodes)), f1 as (select * from s0)")
    state, steps = "s0", []
    for i in range(1, 5):
        done = " union all ".join(f"select seed, key from f{j}" for j in range(1, i + 1))
        q.append(f"b{i} as (select f.seed, a.t as key, f.signal * 0.7::double * a.cond as signal, rel, src, dst from f{i} f join star_adj a on a.f = f.key where structural)")
        q.append(f"s{i} as (select seed, key, max(signal) as signal, bool_or(pinned) as pinned from (select * from {state} union all select seed, key, signal, true from b{i}) group by all)")
        state = f"s{i}"
        steps.append(f"b{i}")
        q.append(f"f{i + 1} as (select * from {state} where (seed, key) in (select (seed, key) from b{i}) and (seed, key) not in (select (seed, key) from ({done})))")
    q.append(f"lf as (select * from (select s.seed, a.t as key, s.signal * 0.7::double * a.cond as signal, rel, src, dst, row_number() over (partition by s.seed, a.f order by a.t) as rn from {state} s join star_nodes n on n.key = s.key and n.kind = 'supplier' join star_adj a on a.f = s.key and rel = 'SUPPLIER_PART') where rn <= 25)")
    q.append(f"t0 as (select seed, key, max(signal) as signal, bool_or(pinned) as pinned from (select * from {state} union all select seed, key, signal, true from lf) group by all), g1 as (select seed, key from s0)")
    steps.append("lf")
    state = "t0"
    for r in range(1, rings + 1):
        done = " union all ".join(f"select seed, key from o{j}" for j in range(1, r + 1))
        q.append(f"o{r} as (select s.* from {state} s join g{r} g on g.seed = s.seed and g.key = s.key where (select count(*) from {state} c where c.seed = s.seed) < {max_nodes})")
        q.append(f"c{r} as (select f.seed, f.pinned, a.*, f.signal * 0.7::double * a.cond as new, {leaf_cap} as k, row_number() over (partition by f.seed, a.f, rel order by rnk desc, a.t) as rn from o{r} f join star_adj a on a.f = f.key)")
        compat = " and (not compartments or coalesce(len(x.locs), 0) = 0 or coalesce(len(y.locs), 0) = 0 or list_has_any(x.locs, y.locs))" if compartment_filter else ""
        q.append(f"r{r} as (select c.seed, c.t as key, c.new as signal, c.structural and c.pinned as pinned, rel, src, dst, y.kind, y.degree from c{r} c join star_nodes x on x.key = c.f join star_nodes y on y.key = c.t where (k is null or rn <= k) and new >= 0.05{compat})")
        q.append(f"t{r} as (select seed, key, max(signal) as signal, bool_or(pinned) as pinned from (select * from {state} union all select seed, key, signal, pinned from r{r}) group by all)")
        state = f"t{r}"
        steps.append(f"r{r}")
        q.append(f"g{r + 1} as (select distinct seed, key from r{r} where (kind <> 'part'{' or degree <= 30' if bridge else ''}) and (seed, key) not in (select (seed, key) from ({done})))")
    q.append(f"kept as (select seed, key, signal, pinned from (select *, row_number() over (partition by seed, pinned order by signal desc, key) as rn, count(*) filter (pinned) over (partition by seed) as np from {state}) where pinned or rn <= {max_nodes} - np)")
    rec = " union ".join(f"select seed, rel, src, dst from {s}" for s in steps)
    tied = " where rel <> 'ORDER_PART' or coalesce(len(x.locs), 0) = 0 or coalesce(len(y.locs), 0) = 0 or list_has_any(x.locs, y.locs)" if compartment_filter else ""
    q.append(f"within as (select e.* from ({rec}) e join kept a on a.seed = e.seed and a.key = e.src join kept b on b.seed = e.seed and b.key = e.dst join star_nodes x on x.key = e.src join star_nodes y on y.key = e.dst{tied})")
    # each ring reads the one before several times: without materialization that doubles from ring to ring
    return "with " + ",\n".join(re.sub(r"\b(\w+) as \(", r"\1 as materialized (", x, count=1) if not x.startswith("\nstar") else x for x in q) + "\n" + what


NODES_SQL = "select seed, kept.key, kind, signal, pinned from kept join star_nodes n on n.key = kept.key"
EDGES_SQL = "select seed, rel, src, dst from within"


def signal_decay_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, SEEDS)[0]


def signal_decay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, SEEDS[:2])[1]


def signal_decay_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, ["O:11", "C:5"], compartment_filter=True)[1]


def signal_decay_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, ["O:11"], bridge=True, max_nodes=120)[0]


def star_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = star.nodes(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("degree").alias("with_degree"), F.lit("node").alias("what"))
    e = star.edges(spark, sf_dir).groupBy(F.col("rel").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("with_degree"), F.lit("edge").alias("what"))
    return n.unionByName(e)


def edge_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adjacency(star.edges(spark, sf_dir), star.SPEC)
    return a.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.min("cond").alias("least"), F.max("cond").alias("most"), F.max("cap").alias("cap"))


def capped_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = star.parts(spark, sf_dir)
    a = adjacency(star.edges(spark, sf_dir, parts).filter("rel = 'SUPPLIER_PART'"), star.SPEC)
    return traverse.capped(a, ["from"], {25}, parts).select("from", "to", "rank")


def multi_seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _walk(spark, sf_dir, ["S:1", "S:2", "O:11"])
    n, e = paths.merge_graphs(n, e)
    parts = paths.connected_components(n.select("key"), e.select("src", "dst"))
    return n.select("key", "kind").join(parts, "key")


def component_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.edges(spark, sf_dir).filter("rel in ('CUSTOMER_ORDER', 'REGION_NATION', 'NATION_SUPPLIER')")
    keys = star.nodes(spark, sf_dir).filter("kind in ('customer', 'order', 'region', 'nation', 'supplier')").select("key")
    parts = paths.connected_components(keys, e)
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.max("key").alias("last"))


def shortest_path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.edges(spark, sf_dir).filter("rel in ('CUSTOMER_ORDER', 'NATION_CUSTOMER', 'NATION_SUPPLIER', 'REGION_NATION')")
    asked = [("C:5", "S:7"), ("O:11", "C:9"), ("O:11", "R:2"), ("R:0", "R:1")]
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "pair long, source string, target string")
    hops = paths.shortest_paths(pairs, e).groupBy("pair").agg(F.max("step").cast("int").alias("hops"))
    return pairs.join(hops, "pair", "left").select("source", "target", "hops", paths.path_quality(F.col("hops")).alias("quality"))


def transcript_like_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.around(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), "O:11")


def edge_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.edge_detail(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), "C:5", "CUSTOMER_ORDER")


def incident_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.tabs(star.edges(spark, sf_dir), "P:3")


def reachable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two hops from a customer's order to a part: the first part of each customer."""
    return neighbourhood.first_reachable(star.edges(spark, sf_dir), "CUSTOMER_ORDER", "ORDER_PART")


def rollup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.rollup(star.edges(spark, sf_dir), "NATION_CUSTOMER", "CUSTOMER_ORDER").groupBy("src").agg(F.count(F.lit(1)).alias("targets"), F.min("dst").alias("first"))


def degree_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = star.nodes(spark, sf_dir).filter("kind = 'part'")
    return n.select("key", "degree", traverse.bridges(star.SPEC).alias("bridges"))


def compartment_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = star.nodes(spark, sf_dir).select("key", "locs")
    e = star.edges(spark, sf_dir).filter("rel = 'ORDER_PART'").join(n.select(F.col("key").alias("src"), F.col("locs").alias("a")), "src").join(n.select(F.col("key").alias("dst"), F.col("locs").alias("b")), "dst")
    return e.groupBy(compatible(F.col("a"), F.col("b")).alias("compatible")).agg(F.count(F.lit(1)).alias("n"))


def hub_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = neighbourhood.degrees(star.edges(spark, sf_dir))
    return d.orderBy(F.desc("degree"), "key").limit(50)


def node_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nodes of each kind show; fields that are null are left out."""
    fields = {"supplier": ("subtype",), "part": ("subtype", "degree"), "order": ("subtype", "locs")}
    return neighbourhood.node_payloads(star.nodes(spark, sf_dir), fields)


def edge_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.edges(spark, sf_dir).filter("rel in ('NATION_SUPPLIER', 'ORDER_PART')").withColumn("score", F.col("score").cast("int"))
    return neighbourhood.edge_payloads(e)


def _compact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = star.nodes(spark, sf_dir).filter("kind in ('region', 'nation', 'supplier')")
    return neighbourhood.compact(n, star.edges(spark, sf_dir), [F.length("key").asc()])


def compact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compact(spark, sf_dir)[0]


def compact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compact(spark, sf_dir)[1]


def kind_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's page: its nation and parts."""
    return neighbourhood.around_kind(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), "S:3", ["nation", "part"], ["NATION_SUPPLIER", "SUPPLIER_PART"])


def edges_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.edges(spark, sf_dir).filter("rel in ('REGION_NATION', 'NATION_SUPPLIER')").select("rel", "src", "dst")
    return upsert.export_edges(e, form="json")


def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shortest path with its nodes' names; of equally short ones the one with the smallest keys backwards."""
    e = star.edges(spark, sf_dir).filter("rel in ('CUSTOMER_ORDER', 'NATION_CUSTOMER', 'NATION_SUPPLIER', 'REGION_NATION')")
    return paths.shortest_path(e, "C:5", "S:2").join(star.nodes(spark, sf_dir).select("key", "kind", "name"), "key").select("step", "key", "kind", "name")


QUERIES = {f.__name__: f for f in (signal_decay_nodes, signal_decay_edges, signal_decay_compartments, signal_decay_bridge, star_graph_counts, edge_conductance, capped_neighbours, multi_seed_merge, component_of_customers, shortest_path_hops, transcript_like_neighbourhood, edge_detail, incident_tabs, reachable_pairs, rollup_edges, degree_gate, compartment_compatibility, hub_degrees, node_payloads, edge_payloads, compact_nodes, compact_edges, kind_neighbours, edges_as_json, path_nodes)}

_W = f"with recursive {star.SQL}"
ORACLE_SQL = {
    "signal_decay_nodes": walk_sql(SEEDS, NODES_SQL),
    "signal_decay_edges": walk_sql(SEEDS[:2], EDGES_SQL),
    "signal_decay_compartments": walk_sql(["O:11", "C:5"], EDGES_SQL, compartment_filter=True),
    "signal_decay_bridge": walk_sql(["O:11"], NODES_SQL, max_nodes=120, bridge=True),
    "star_graph_counts": f"{_W} select kind, count(*) as n, count(degree) as with_degree, 'node' as what from star_nodes group by kind union all select rel, count(*), count(score), 'edge' from star_edges group by rel",
    "edge_conductance": f"{_W} select rel, count(*) as n, min(cond) as least, max(cond) as most, max(cap) as cap from star_adj group by rel",
    "capped_neighbours": f"{_W} select f as \"from\", t as \"to\", rnk as rank from (select *, row_number() over (partition by f order by rnk desc, t) as rn from star_adj where rel = 'SUPPLIER_PART') where rn <= 25",
    "multi_seed_merge": walk_sql(["S:1", "S:2", "O:11"], """, e as (select distinct src, dst from within), k as (select distinct key from kept), u as (select src as a, dst as b from e union select dst, src from e),
l as (select key as node, key as comp from k union select u.b, l.comp from l join u on u.a = l.node where l.comp < u.b)
select n.key, n.kind, min(comp) as component from l join star_nodes n on n.key = l.node group by n.key, n.kind""").replace("with ", "with recursive ", 1).replace("\n, e as", ", e as"),
    "component_of_customers": f"""{_W}, e as (select src, dst from star_edges where rel in ('CUSTOMER_ORDER', 'REGION_NATION', 'NATION_SUPPLIER')), u as (select src as a, dst as b from e union select dst, src from e),
l as (select key as node, key as comp from star_nodes where kind <> 'part' union select u.b, l.comp from l join u on u.a = l.node where l.comp < u.b), m as (select node, min(comp) as component from l group by node)
select component, count(*) as members, max(node) as last from m group by component""",
    "shortest_path_hops": f"""{_W}, u as (select f as a, t as b from star_adj where rel in ('CUSTOMER_ORDER', 'NATION_CUSTOMER', 'NATION_SUPPLIER', 'REGION_NATION')),
q(source, target) as (values ('C:5', 'S:7'), ('O:11', 'C:9'), ('O:11', 'R:2'), ('R:0', 'R:1')),
l as (select source, source as node, 0 as h from q union select l.source, u.b, l.h + 1 from l join u on u.a = l.node where l.h < 6)
select source, target, cast(h as int) as hops, case when h is null then 'no_path' when h <= 2 then 'direct' when h <= 4 then 'moderate' else 'weak' end as quality
from (select q.source, q.target, min(l.h) as h from q left join l on l.source = q.source and l.node = q.target group by q.source, q.target)""",
    "transcript_like_neighbourhood": f"{_W} select n.key, n.kind, n.name, a.rel, a.src = 'O:11' as outgoing from star_adj a join star_nodes n on n.key = a.t where a.f = 'O:11'",
    "edge_detail": f"{_W} select e.src, e.rel, e.dst, e.src || '__' || e.rel || '__' || e.dst as eid, e.score, coalesce(e.tier, 'canonical') as tier, a.name as src_name, b.name as dst_name from star_edges e join star_nodes a on a.key = e.src join star_nodes b on b.key = e.dst where e.src = 'C:5' and e.rel = 'CUSTOMER_ORDER'",
    "incident_tabs": f"{_W} select case when tier = 'literature' then 'LITERATURE' else rel end as tab, count(*) as n, min(t) as first from star_adj where f = 'P:3' group by 1",
    "reachable_pairs": f"{_W} select a.src, min(b.dst) as dst from star_edges a join star_edges b on a.dst = b.src where a.rel = 'CUSTOMER_ORDER' and b.rel = 'ORDER_PART' group by a.src",
    "rollup_edges": f"{_W} select src, count(*) as targets, min(dst) as first from (select distinct a.src, b.dst from star_edges a join star_edges b on a.dst = b.src where a.rel = 'NATION_CUSTOMER' and b.rel = 'CUSTOMER_ORDER') group by src",
    "degree_gate": f"{_W} select key, degree, coalesce(degree <= 30, false) as bridges from star_nodes where kind = 'part'",
    "compartment_compatibility": f"{_W} select coalesce(len(a.locs) = 0 or len(b.locs) = 0 or list_has_any(a.locs, b.locs), true) as compatible, count(*) as n from star_edges e join star_nodes a on a.key = e.src join star_nodes b on b.key = e.dst where rel = 'ORDER_PART' group by 1",
    "hub_degrees": f"{_W} select key, degree from (select f as key, count(*) as degree from star_adj group by f) order by degree desc, key limit 50",
    "node_payloads": f"""{_W} select key, kind, coalesce(name, key) as label, case kind when 'supplier' then '{{"subtype":"' || subtype || '"}}' when 'part' then '{{"subtype":"' || subtype || '","degree":' || degree || '}}' when 'order' then '{{"subtype":"' || subtype || '"' || case when locs is null then '' else ',"locs":["' || array_to_string(locs, '","') || '"]' end || '}}' else '{{}}' end as payload from star_nodes""",
    "edge_payloads": f"""{_W} select src || '__' || rel || '__' || dst as eid, rel, src, dst, coalesce(tier, 'canonical') as tier, case when score is null then '{{}}' else '{{"score":' || cast(trunc(score) as int) || '}}' end as payload from star_edges where rel in ('NATION_SUPPLIER', 'ORDER_PART')""",
    "compact_nodes": f"{_W} select key, kind, coalesce(name, key) as label from star_nodes where kind in ('region', 'nation', 'supplier') order by length(key), key limit 60",
    "compact_edges": f"{_W}, k as (select key, coalesce(name, key) as label from star_nodes where kind in ('region', 'nation', 'supplier') order by length(key), key limit 60) select distinct a.label as source, rel as relation, b.label as target from star_edges e join k a on a.key = e.src join k b on b.key = e.dst",
    "kind_neighbours": f"{_W} select n.key, n.kind, n.name, a.rel, a.src = 'S:3' as outgoing from star_adj a join star_nodes n on n.key = a.t where a.f = 'S:3' and n.kind in ('nation', 'part') and a.rel in ('NATION_SUPPLIER', 'SUPPLIER_PART')",
    "edges_as_json": f"""{_W} select '{{"rel":"' || rel || '","src":"' || src || '","dst":"' || dst || '"}}' as line from star_edges where rel in ('REGION_NATION', 'NATION_SUPPLIER')""",
    "path_nodes": f"""{_W}, u as (select distinct f as a, t as b from star_adj where rel in ('CUSTOMER_ORDER', 'NATION_CUSTOMER', 'NATION_SUPPLIER', 'REGION_NATION')),
l as (select 'C:5' as node, 0 as h union select u.b, l.h + 1 from l join u on u.a = l.node where l.h < 6), d as (select node, min(h) as h from l group by node),
p as (select 'S:2' as key, h as step from d where node = 'S:2' union all select (select min(u.a) from u join d on d.node = u.a where u.b = p.key and d.h = p.step - 1), p.step - 1 from p where p.step > 0)
select cast(step as int) as step, p.key, kind, name from p join star_nodes n on n.key = p.key""",
}
