"""The graph model: kinds of nodes, relations with conductance, rank and cap, and both orientations of edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("subtype", T.StringType()), T.StructField("locs", T.ArrayType(T.StringType())), T.StructField("degree", T.LongType())])
EDGES = T.StructType([T.StructField("rel", T.StringType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("tier", T.StringType())])

#: Fixed order of the kind-specific ids that make up a node's one key.
KEYS = ("ensembl_id", "ensembl_tx_id", "uniprot_id", "rsid", "ontology_id", "hmdb_id", "chebi_id")


@dataclass(frozen=True)
class Relation:
    """How one type of edge conducts: `scale` and `offset` turn its score into a conductance in 0..1, `missing` stands in for a null score; `cap` bounds how many of a node's edges a ring follows."""

    scale: float = 1.0
    offset: float = 0.0
    missing: float = 0.5
    constant: float | None = None
    absolute: bool = False
    minus_log10: bool = False
    cap: int | None = None
    by_key: bool = False
    structural: bool = False
    compartments: bool = False
    directed: bool = True


@dataclass(frozen=True)
class GraphSpec:
    """A typed graph: its relations, and the kind whose nodes are leaves unless their degree lets a walk pass."""

    relations: dict[str, Relation]
    leaf_kind: str | None = None
    leaf_relation: str | None = None
    leaf_host: str | None = None
    leaf_cap: int = 25
    bridge_degree: int = 30
    bridge_cap: int = 8
    never_bridge: frozenset[str] = field(default_factory=frozenset)
    tier_discount: float = 0.5
    discounted_tier: str = "literature"


#: Fixed values of the eleven biological relations.
OMICS = GraphSpec(
    relations={
        "REGULATES": Relation(missing=0.5, cap=25),
        "PRODUCES": Relation(constant=0.9, structural=True),
        "TRANSLATES_TO": Relation(constant=1.0, structural=True),
        "ENCODES": Relation(constant=1.0, structural=True),
        "INTERACTS_WITH": Relation(missing=0.5, cap=10, compartments=True, directed=False),
        "ASSOCIATED_WITH": Relation(scale=1 / 30, missing=0.4, minus_log10=True, cap=10),
        "IN_GENE": Relation(constant=1.0, cap=10, by_key=True),
        "IMPLICATED_IN": Relation(constant=0.5, cap=10, by_key=True),
        "DIFFERENTIALLY_EXPRESSED": Relation(scale=0.25, missing=0.25, absolute=True, cap=10),
        "CATALYSES": Relation(constant=0.7),
        "GENE_DISEASE_ASSOC": Relation(scale=0.5, offset=0.5, missing=0.6, cap=10),
    },
    leaf_kind="metabolite",
    leaf_relation="CATALYSES",
    leaf_host="protein",
    # fixed lower-case names of metabolites that are everywhere
    never_bridge=frozenset({"h2o", "water", "h+", "proton", "atp", "adp", "amp", "gtp", "gdp", "nad+", "nadh", "nadp+", "nadph", "coa", "coenzyme a", "co2", "carbon dioxide", "o2", "oxygen", "pi", "phosphate", "ppi", "diphosphate", "pyrophosphate", "nh3", "nh4+", "ammonia"}),
)


def _scored(rel: Relation) -> Column:
    """A relation's usable score: null where there is none, -log10 of a p-value above 0, the magnitude of a fold change."""
    if rel.minus_log10:
        return F.when(F.col("score") > 0, -F.log10("score"))
    return F.abs("score") if rel.absolute else F.col("score")


def _by_relation(spec: GraphSpec, value) -> Column:
    out = F.lit(None)
    for name, rel in spec.relations.items():
        out = F.when(F.col("rel") == name, value(rel)).otherwise(out)
    return out


def conductance(spec: GraphSpec) -> Column:
    """Share of the signal that an edge (rel, score, tier) passes on; a literature edge passes half of it."""

    def base(rel: Relation) -> Column:
        if rel.constant is not None:
            return F.lit(float(rel.constant))
        linear = _scored(rel) * rel.scale if rel.scale != 1 else _scored(rel)
        linear = linear + rel.offset if rel.offset else linear
        return F.when(linear.isNull(), F.lit(float(rel.missing))).otherwise(F.least(F.lit(1.0), linear))

    discount = F.when(F.col("tier") == spec.discounted_tier, F.lit(spec.tier_discount)).otherwise(F.lit(1.0))
    return _by_relation(spec, base).cast("double") * discount


def rank(spec: GraphSpec) -> Column:
    """What a cap keeps first; relations capped by key all rank 0."""
    return F.coalesce(_by_relation(spec, lambda r: F.lit(0.0) if r.by_key or r.constant is not None else _scored(r)).cast("double"), F.lit(0.0))


def cap(spec: GraphSpec, bridge: bool) -> Column:
    def of(name: str, r: Relation) -> int | None:
        return spec.bridge_cap if bridge and name == spec.leaf_relation and r.cap is None else r.cap

    out = F.lit(None).cast("int")
    for name, rel in spec.relations.items():
        if of(name, rel) is not None:
            out = F.when(F.col("rel") == name, F.lit(of(name, rel))).otherwise(out)
    return out


def adjacency(edges: DataFrame, spec: GraphSpec, bridge: bool = False) -> DataFrame:
    """Both orientations of each edge, with what a walk needs: (from, to, rel, src, dst, cond, rank, cap, structural, compartments)."""
    known = edges.filter(F.col("rel").isin(*spec.relations))
    flags = [_by_relation(spec, lambda r, f=f: F.lit(getattr(r, f))).cast("boolean").alias(f) for f in ("structural", "compartments")]
    ready = known.select("rel", "src", "dst", conductance(spec).alias("cond"), rank(spec).alias("rank"), cap(spec, bridge).alias("cap"), *flags)
    return ready.select(F.col("src").alias("from"), F.col("dst").alias("to"), "*").unionByName(ready.filter("src <> dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), "*"))


def business_key(df: DataFrame) -> Column:
    """The node key: the first of the kind-specific ids that the table has and that isn't null."""
    return F.coalesce(*[F.col(k) for k in KEYS if k in df.columns])


def compatible(a: Column, b: Column) -> Column:
    """Whether two lists of compartments may meet: they overlap, or one of them is unknown."""
    return F.coalesce((F.size(F.coalesce(a, F.array().cast("array<string>"))) == 0) | (F.size(F.coalesce(b, F.array().cast("array<string>"))) == 0) | F.arrays_overlap(a, b), F.lit(True))
