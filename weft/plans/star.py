"""The driver's star schema as a typed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.model import GraphSpec, Relation
from weft.tables import table

SPEC = GraphSpec(
    relations={
        "REGION_NATION": Relation(constant=0.9, structural=True),
        "NATION_SUPPLIER": Relation(constant=1.0, structural=True),
        "NATION_CUSTOMER": Relation(constant=1.0, cap=10, by_key=True),
        "CUSTOMER_ORDER": Relation(scale=2e-6, cap=10),
        "ORDER_PART": Relation(scale=0.02, cap=10, compartments=True),
        "SUPPLIER_PART": Relation(cap=25),
    },
    leaf_kind="part",
    leaf_relation="SUPPLIER_PART",
    leaf_host="supplier",
    bridge_degree=30,
)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, kind, name, subtype, locs, degree): locs are an order's or a part's line statuses, degree a part's orders."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem")
    part_stats = lines.groupBy(F.col("l_partkey").alias("k")).agg(F.array_sort(F.collect_set("l_linestatus")).alias("locs"), F.countDistinct("l_orderkey").alias("degree"))
    order_stats = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_linestatus")).alias("locs"))
    no_locs, no_degree = F.lit(None).cast("array<string>").alias("locs"), F.lit(None).cast("long").alias("degree")

    def kind(df: DataFrame, mark: str, name: str, key: str, label: str, subtype: str, locs=no_locs, degree=no_degree) -> DataFrame:
        return df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("key"), F.lit(name).alias("kind"), F.col(label).alias("name"), F.col(subtype).alias("subtype"), locs, degree)

    parts = t("part").join(part_stats, F.col("p_partkey") == F.col("k"), "left")
    orders = t("orders").join(order_stats, F.col("o_orderkey") == F.col("k"), "left")
    out = kind(t("region"), "R:", "region", "r_regionkey", "r_name", "r_name")
    for x in (
        kind(t("nation"), "N:", "nation", "n_nationkey", "n_name", "n_name"),
        kind(t("customer"), "C:", "customer", "c_custkey", "c_name", "c_mktsegment"),
        kind(t("supplier"), "S:", "supplier", "s_suppkey", "s_name", "s_name"),
        kind(parts, "P:", "part", "p_partkey", "p_name", "p_type", F.col("locs"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree")),
        kind(orders, "O:", "order", "o_orderkey", "o_orderpriority", "o_orderstatus", F.col("locs")),
    ):
        out = out.unionByName(x)
    return out


#: Lines that a task deals with at most, where tasks follow the input.
PART = 1 << 19


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for all lines."""
    return table(spark, sf_dir, "lineitem").count() // PART + 1


def edges(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(rel, src, dst, score, tier); a pair of an order and a part counts as literature if all its lines were returned. `parts`: tasks that suppliers' lines are dealt to."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda mark, column: F.concat(F.lit(mark), F.col(column).cast("string"))
    none, no_tier = F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("tier")

    def rel(df: DataFrame, name: str, src, dst, score=none, tier=no_tier) -> DataFrame:
        return df.select(F.lit(name).alias("rel"), src.alias("src"), dst.alias("dst"), score, tier)

    lines = t("lineitem")
    order_part = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("score"), F.when(F.bool_and(F.col("l_returnflag") == "R"), "literature").alias("tier"))
    supplied = lines.repartition(parts, "l_suppkey", "l_partkey") if parts and parts > 1 else lines
    supplier_part = supplied.groupBy("l_suppkey", "l_partkey").agg((1 - F.max("l_discount")).alias("score"))
    out = rel(t("nation"), "REGION_NATION", key("R:", "n_regionkey"), key("N:", "n_nationkey"))
    for x in (
        rel(t("supplier"), "NATION_SUPPLIER", key("N:", "s_nationkey"), key("S:", "s_suppkey")),
        rel(t("customer"), "NATION_CUSTOMER", key("N:", "c_nationkey"), key("C:", "c_custkey")),
        rel(t("orders"), "CUSTOMER_ORDER", key("C:", "o_custkey"), key("O:", "o_orderkey"), F.col("o_totalprice").alias("score")),
        rel(order_part, "ORDER_PART", key("O:", "l_orderkey"), key("P:", "l_partkey"), F.col("score"), F.col("tier")),
        rel(supplier_part, "SUPPLIER_PART", key("S:", "l_suppkey"), key("P:", "l_partkey"), F.col("score")),
    ):
        out = out.unionByName(x)
    return out


#: The same graph in DuckDB's SQL.
SQL = """
star_nodes as (
  select 'R:' || r_regionkey as key, 'region' as kind, r_name as name, r_name as subtype, cast(null as varchar[]) as locs, cast(null as bigint) as degree from region
  union all select 'N:' || n_nationkey, 'nation', n_name, n_name, null, null from nation
  union all select 'C:' || c_custkey, 'customer', c_name, c_mktsegment, null, null from customer
  union all select 'S:' || s_suppkey, 'supplier', s_name, s_name, null, null from supplier
  union all select 'P:' || p_partkey, 'part', p_name, p_type, l.locs, coalesce(l.d, 0) from part left join (select l_partkey, list_sort(list(distinct l_linestatus)) as locs, count(distinct l_orderkey) as d from lineitem group by 1) l on p_partkey = l_partkey
  union all select 'O:' || o_orderkey, 'order', o_orderpriority, o_orderstatus, l.locs, null from orders left join (select l_orderkey, list_sort(list(distinct l_linestatus)) as locs from lineitem group by 1) l on o_orderkey = l_orderkey),
star_edges as (
  select 'REGION_NATION' as rel, 'R:' || n_regionkey as src, 'N:' || n_nationkey as dst, cast(null as double) as score, cast(null as varchar) as tier from nation
  union all select 'NATION_SUPPLIER', 'N:' || s_nationkey, 'S:' || s_suppkey, null, null from supplier
  union all select 'NATION_CUSTOMER', 'N:' || c_nationkey, 'C:' || c_custkey, null, null from customer
  union all select 'CUSTOMER_ORDER', 'C:' || o_custkey, 'O:' || o_orderkey, o_totalprice, null from orders
  union all select 'ORDER_PART', 'O:' || l_orderkey, 'P:' || l_partkey, max(l_quantity), case when bool_and(l_returnflag = 'R') then 'literature' end from lineitem group by l_orderkey, l_partkey
  union all select 'SUPPLIER_PART', 'S:' || l_suppkey, 'P:' || l_partkey, 1 - max(l_discount), null from lineitem group by l_suppkey, l_partkey),
star_adj as (
  select *, case rel when 'REGION_NATION' then 0.9::double when 'NATION_SUPPLIER' then 1.0::double when 'NATION_CUSTOMER' then 1.0::double when 'CUSTOMER_ORDER' then least(1.0::double, score * 2e-6::double) when 'ORDER_PART' then least(1.0::double, score * 0.02::double) else least(1.0::double, score) end
              * (case when tier = 'literature' then 0.5::double else 1.0::double end) as cond,
         case when rel in ('CUSTOMER_ORDER', 'ORDER_PART', 'SUPPLIER_PART') then score else 0.0::double end as rnk,
         case rel when 'NATION_CUSTOMER' then 10 when 'CUSTOMER_ORDER' then 10 when 'ORDER_PART' then 10 when 'SUPPLIER_PART' then 25 end as cap,
         rel in ('REGION_NATION', 'NATION_SUPPLIER') as structural, rel = 'ORDER_PART' as compartments
  from (select src as f, dst as t, * from star_edges union all select dst, src, * from star_edges))
"""
