"""Point lookups and rollups around one node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incident(edges: DataFrame, key: str) -> DataFrame:
    """Edges at a node with the other end and whether they go out."""
    mine = edges.filter((F.col("src") == key) | (F.col("dst") == key))
    return mine.withColumn("outgoing", F.col("src") == key).withColumn("other", F.when(F.col("src") == key, F.col("dst")).otherwise(F.col("src")))


def around(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Direct neighbours of a node, a row for each edge."""
    return incident(edges, key).join(nodes, F.col("other") == F.col("key")).select("key", "kind", "name", "rel", "outgoing")


def edge_detail(nodes: DataFrame, edges: DataFrame, src: str, rel: str, dst: str | None = None) -> DataFrame:
    """Edges by business keys with names of both ends; no tier means canonical."""
    found = edges.filter((F.col("src") == src) & (F.col("rel") == rel))
    found = found if dst is None else found.filter(F.col("dst") == dst)
    named = found.join(nodes.select(F.col("key").alias("src"), F.col("name").alias("src_name")), "src").join(nodes.select(F.col("key").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return named.select("src", "rel", "dst", F.concat_ws("__", "src", "rel", "dst").alias("eid"), "score", F.coalesce("tier", F.lit("canonical")).alias("tier"), "src_name", "dst_name")


def tabs(edges: DataFrame, key: str) -> DataFrame:
    """Incident edges grouped for display: by relation, all literature edges together."""
    tab = F.when(F.col("tier") == "literature", "LITERATURE").otherwise(F.col("rel"))
    return incident(edges, key).groupBy(tab.alias("tab")).agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first"))


def first_reachable(edges: DataFrame, first: str, second: str) -> DataFrame:
    """For each source the smallest node that the two relations reach one after the other."""
    a = edges.filter(F.col("rel") == first).select("src", F.col("dst").alias("via"))
    b = edges.filter(F.col("rel") == second).select(F.col("src").alias("via"), "dst")
    return a.join(b, "via").groupBy("src").agg(F.min("dst").alias("dst"))


def rollup(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct pairs that two relations connect."""
    a = edges.filter(F.col("rel") == first).select("src", F.col("dst").alias("via"))
    b = edges.filter(F.col("rel") == second).select(F.col("src").alias("via"), "dst")
    return a.join(b, "via").select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, both directions."""
    return edges.select(F.col("src").alias("key")).unionByName(edges.filter("src <> dst").select(F.col("dst").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("degree"))


def legend(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kinds of nodes and edges that are present."""
    return nodes.select(F.lit("node").alias("what"), "kind").distinct().unionByName(edges.select(F.lit("edge").alias("what"), F.col("rel").alias("kind")).distinct())


def lookup(nodes: DataFrame, kind: str, key: str, column: str = "key") -> DataFrame:
    """The node of a kind with this id, or this value of another column, as a symbol."""
    return nodes.filter((F.col("kind") == kind) & (F.col(column) == key))


def around_kind(nodes: DataFrame, edges: DataFrame, key: str, kinds: list[str], rels: list[str] | None = None) -> DataFrame:
    """Direct neighbours of a node that are of some kinds, over some relations: what a page about a gene, a disease or a metabolite shows."""
    found = around(nodes, edges if rels is None else edges.filter(F.col("rel").isin(*rels)), key)
    return found.filter(F.col("kind").isin(*kinds))


#: Fields that a node of each kind shows beside its key and name.
NODE_FIELDS = {"gene": ("hgnc_symbol", "chromosome", "pli_score", "cancer_gene"), "transcript": ("biotype", "length_bp"), "protein": ("subtype", "subcellular_locs"), "disease": ("ontology_id",), "variant": ("clinical_significance", "gnomad_af"), "metabolite": ("formula", "degree")}


def node_payloads(nodes: DataFrame, fields: dict[str, tuple[str, ...]] = NODE_FIELDS) -> DataFrame:
    """(key, kind, label, payload): a JSON object with the fields of the node's kind that it has; null ones are left out."""
    payload = F.lit("{}")
    for kind, names in fields.items():
        here = [F.col(n) for n in names if n in nodes.columns]
        if here:
            payload = F.when(F.col("kind") == kind, F.to_json(F.struct(*here))).otherwise(payload)
    return nodes.select("key", "kind", F.coalesce("name", "key").alias("label"), payload.alias("payload"))


def edge_payloads(edges: DataFrame, pmids: str | None = None) -> DataFrame:
    """(eid, rel, src, dst, tier, payload): an edge's id, its tier (canonical if none) and a JSON object of its other fields; publication ids become strings."""
    rest = [F.transform(F.col(c), lambda p: p.cast("string")).alias(c) if c == pmids else F.col(c) for c in edges.columns if c not in ("rel", "src", "dst", "tier")]
    return edges.select(F.concat_ws("__", "src", "rel", "dst").alias("eid"), "rel", "src", "dst", F.coalesce("tier", F.lit("canonical")).alias("tier"), F.to_json(F.struct(*rest)).alias("payload"))


#: Fixed number of nodes that a compact graph shows.
COMPACT = 60


def compact(nodes: DataFrame, edges: DataFrame, order: list, limit: int = COMPACT) -> tuple[DataFrame, DataFrame]:
    """The first `limit` nodes by `order` as (key, kind, label), and the edges between them as (source, relation, target) of labels."""
    kept = nodes.orderBy(*order, "key").limit(limit).select("key", "kind", F.coalesce("name", "key").alias("label"))
    ends = edges.join(kept.select(F.col("key").alias("src"), F.col("label").alias("source")), "src").join(kept.select(F.col("key").alias("dst"), F.col("label").alias("target")), "dst")
    return kept, ends.select("source", F.col("rel").alias("relation"), "target").distinct()


#: Fixed names of kinds by label.
KIND_OF_LABEL = {"Gene": "gene", "Transcript": "transcript", "Protein": "protein", "Variant": "variant", "Disease": "disease", "Metabolite": "metabolite"}


def kind_of(labels: Column) -> Column:
    """The kind that a node's labels say, the first known one; else unknown."""
    known = F.create_map(*[F.lit(x) for kv in KIND_OF_LABEL.items() for x in kv])
    return F.coalesce(F.get(F.filter(F.transform(labels, lambda x: known[x]), lambda k: k.isNotNull()), 0), F.lit("unknown"))
