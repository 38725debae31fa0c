"""Queries of joins, aggregates, rankings, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators import conversations
from weft.operators import relational as R
from weft.operators import upsert
from weft.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("select c_custkey, c_name, c_acctbal from customer where trim(c_name) <> '' and c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal >= 5000")
def filter_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter((F.trim("c_name") != "") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") >= 5000)).select("c_custkey", "c_name", "c_acctbal")


@query("select l_orderkey, l_partkey, l_quantity / 50 as share from lineitem where cast(cast(l_quantity as varchar) as double) >= 45 and l_orderkey <> l_partkey and l_partkey in (select p_partkey from part where p_size > 25)")
def threshold_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from text over a threshold, without self-loops, with ends that exist."""
    big = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity").cast("string").try_cast("double") >= 45) & (F.col("l_orderkey") != F.col("l_partkey")))
    return rows.join(big, "l_partkey", "left_semi").select("l_orderkey", "l_partkey", (F.col("l_quantity") / 50).alias("share"))


@query("select p_partkey, p_name from part p where p_brand = 'Brand#2' and p_size between 10 and 30 and exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def optional_filters_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.where(table(spark, sf_dir, "part"), {"p_brand": "Brand#2", "p_type": None}).filter(F.col("p_size").between(10, 30))
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return parts.join(returned, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def not_exists_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query("select o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey, min(o_totalprice) as best from orders group by o_custkey")
def best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.min("o_totalprice").alias("best"))


@query("select l_partkey, max(l_quantity) as top, count(*) as n_evidence, list_sort(list(distinct l_returnflag)) as sources from lineitem group by l_partkey")
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("top"), F.count(F.lit(1)).alias("n_evidence"), F.array_sort(F.collect_set("l_returnflag")).alias("sources"))


@query("""select n_name, up, down, total, t.keys as top from (select c_nationkey, count(*) filter (o_totalprice >= 250000) as up, count(*) filter (o_totalprice < 250000) as down, count(*) as total from orders join customer on o_custkey = c_custkey group by 1)
join (select c_nationkey as k, list(o_orderkey order by rn) as keys from (select c_nationkey, o_orderkey, row_number() over (partition by c_nationkey order by o_totalprice desc, o_orderkey) as rn from orders join customer on o_custkey = c_custkey) where rn <= 5 group by 1) t on t.k = c_nationkey
join nation on n_nationkey = c_nationkey""")
def updown_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy("c_nationkey").agg(F.count_if(F.col("o_totalprice") >= 250000).alias("up"), F.count_if(F.col("o_totalprice") < 250000).alias("down"), F.count(F.lit(1)).alias("total"))
    top = R.top_list(rows, ["c_nationkey"], [F.desc("o_totalprice"), F.col("o_orderkey").asc()], "o_orderkey", 5, "top")
    return counts.join(top, "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "up", "down", "total", "top")


@query("""with w as (select o_custkey, sum(o_totalprice) as v from orders group by 1), p as (select quantile_cont(v, 0.99) as q from w)
select o_custkey, round(greatest(0, least(1, v / q)), 6) as weight from w, p""")
def percentile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 99th percentile (linear), then divided by it and clipped."""
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return R.clipped_by_percentile(totals, "v", 0.99, "weight").select("o_custkey", F.round("weight", 6).alias("weight"))


@query("""select l_partkey, round(a - n, 6) as diff, case when a - n >= 0 then 'up' else 'down' end as direction from
(select l_partkey, median(l_extendedprice) filter (l_returnflag = 'A') as a, median(l_extendedprice) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'A') as ca, count(*) filter (l_returnflag = 'N') as cn from lineitem group by 1)
where ca >= 10 and cn >= 10 and abs(a - n) >= 5000""")
def median_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_returnflag")
    return R.median_difference(rows, "l_partkey", "l_extendedprice", "l_returnflag", "A", "N", least=10, threshold=5000)


@query("select l_partkey, count(*) as degree, count(distinct l_orderkey) as orders from lineitem group by l_partkey")
def edge_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("l_orderkey").alias("orders"))


@query("""with b as (select l_orderkey as k, l_linestatus as loc, l_tax as s from lineitem union all select l_partkey, l_returnflag, l_discount from lineitem), m as (select k, loc, max(s) as s from b where loc <> 'R' group by 1, 2)
select k, list(loc order by s desc, loc) as locs from (select *, row_number() over (partition by k order by s desc, loc) as rn from m) where rn <= 3 group by k""")
def top_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score for each (key, place) over both ends of an edge, noise removed, top three by score and name."""
    lines = table(spark, sf_dir, "lineitem")
    both = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("loc"), F.col("l_tax").alias("s")).unionAll(lines.select("l_partkey", "l_returnflag", "l_discount"))
    best = both.filter("loc <> 'R'").groupBy("k", "loc").agg(F.max("s").alias("s"))
    return R.top_list(best, ["k"], [F.desc("s"), F.col("loc").asc()], "loc", 3, "locs")


@query("select l_partkey, list(flag order by first_row, flag) as flags from (select l_partkey, l_returnflag as flag, min(l_orderkey) as first_row from lineitem group by 1, 2) group by 1")
def inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-map turned around: each key's values, once each, in order of their first row, equal ones by themselves."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("v"), F.col("l_orderkey").alias("i"))
    return R.ordered_distinct(rows, "l_partkey", "v", "i", "flags")


@query("""select o_custkey, coalesce(arg_max(o_totalprice, o_orderkey) filter (o_orderstatus = 'F'), arg_min(o_totalprice, o_orderkey)) as preferred, min(coalesce(nullif(trim(o_orderpriority), ''), '1')) as tier, arg_min(o_orderstatus, o_orderkey) as first_status from orders group by o_custkey""")
def preferred_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flagged row's value (the last one) before the first row's; the least tier with a default; the first row's status."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.coalesce(F.max_by("o_totalprice", F.when(status == "F", F.col("o_orderkey"))), F.min_by("o_totalprice", "o_orderkey")).alias("preferred"),
        F.min(F.coalesce(F.nullif(F.trim("o_orderpriority"), F.lit("")), F.lit("1"))).alias("tier"),
        F.min_by("o_orderstatus", "o_orderkey").alias("first_status"),
    )


@query("select n_nationkey, min(s_name) as first_name, arg_min(s_acctbal, s_suppkey) filter (s_acctbal > 0) as first_positive from nation left join supplier on s_nationkey = n_nationkey group by 1")
def first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.groupBy("n_nationkey").agg(F.min("s_name").alias("first_name"), F.min_by("s_acctbal", F.when(F.col("s_acctbal") > 0, F.col("s_suppkey"))).alias("first_positive"))


@query("""select user_id, a as n_affirm, n as n_negate, case when a > 0 then (1 - power(0.5::double, a)) * a / (a + n) else 0 end as confidence from
(select user_id, count(*) filter (event_type = 'purchase') as a, count(*) filter (event_type = 'error') as n from events group by 1)""")
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.functions.normalize import evidence_confidence as confidence

    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n_affirm"), F.count_if(F.col("event_type") == "error").alias("n_negate"))
    return counts.withColumn("confidence", confidence(F.col("n_affirm"), F.col("n_negate")))


@query("""with g as (select doc_id from labels where toxic = 1), p as (select doc_id from labels where quality = 0), c as (select (select count(*) from g join p using (doc_id)) as tp, (select count(*) from p) as np, (select count(*) from g) as ng)
select case when np = 0 then 1 else tp / np end as precision, case when ng = 0 then 1 else tp / ng end as recall, tp as hits, np - tp as extra, ng - tp as missed from c""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return R.precision_recall(labels.filter("toxic = 1").select("doc_id"), labels.filter("quality = 0").select("doc_id"), ["doc_id"]).drop("f1")


@query("select conv_id, max(turn) + 1 as next_seq, count(*) filter (role = 'user') as user_turns from conversations group by conv_id")
def next_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    users = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"))
    return conversations.next_numbers(turns, "conv_id", "turn").join(users, "conv_id")


@query("""with o as (select conv_id, max(turn) as last from conversations where turn % 3 = 0 group by conv_id),
n as (select conv_id, role, text, row_number() over (partition by conv_id order by turn) - 1 as place from conversations where turn % 3 <> 0 and coalesce(text, '') <> '')
select conv_id, cast(coalesce(last + 1, 0) + place as bigint) as seq, role, length(text) as chars from n left join o using (conv_id)""")
def saved_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn is there already, the others are saved behind them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("seq"), "role", "text")
    old, new = rows.filter("seq % 3 = 0"), rows.filter("seq % 3 <> 0")
    return conversations.save(old, new, ["seq"], "conv_id", "text").select("conv_id", "seq", "role", F.length("text").alias("chars"))


@query("select conv_id, turn, role, length(text) as chars from (select *, row_number() over (partition by conv_id order by turn) as rn from conversations where trim(text) <> '') where rn <= 4")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest turns of each session, blank ones ignored."""
    rows = table(spark, sf_dir, "conversations").filter(F.trim("text") != "")
    return conversations.load(rows, 4, "conv_id", "turn").select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query("select count(*) as total, count(*) filter (l_partkey in (select p_partkey from part where p_size > 40)) as matched, count(*) filter (l_tax = 0) as skipped, count(l_discount) as with_discount from lineitem")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit"))
    rows = table(spark, sf_dir, "lineitem").join(big, "l_partkey", "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched"), F.count_if(F.col("l_tax") == 0).alias("skipped"), F.count("l_discount").alias("with_discount"))


@query("select c_custkey, c_name, total, total > 60 + 20 as has_more from (select *, count(*) over () as total from customer where c_acctbal > 0 order by c_acctbal desc, c_custkey limit 20 offset 60)")
def page_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), [F.desc("c_acctbal"), F.col("c_custkey").asc()], size=20, number=3).select("c_custkey", "c_name", "total", "has_more")


@query("select o_orderkey, o_orderpriority from orders order by case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end, o_orderkey limit 40")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority")


@query("""with a as (select o_custkey as k, list_sort(list(distinct o_orderpriority)) as old from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey as k, list_sort(list(distinct o_orderpriority)) as new from orders where o_orderstatus = 'O' group by 1)
select k, list_sort(list_filter(new, lambda x: not list_contains(old, x))) as delta, list_concat(old, list_sort(list_filter(new, lambda x: not list_contains(old, x)))) as enriched, old as reverted from a join b using (k)""")
def delta_enrich_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new is appended and remembered; taking exactly that away again gives the old list."""
    orders = table(spark, sf_dir, "orders")
    side = lambda s, n: orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias(n))
    met = side("F", "old").join(side("O", "new"), "k")
    met = met.withColumn("delta", R.additions("old", "new")).withColumn("enriched", F.concat("old", "delta"))
    return met.select("k", "delta", "enriched", R.without("enriched", "delta").alias("reverted"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, c_mktsegment from customer union all select -c_custkey, c_acctbal + 1, 'NEW' from customer where c_custkey % 3 = 0 and c_custkey > 0""")
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or update by key; applied twice on purpose."""
    current = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    some = current.filter("c_custkey % 3 = 0")
    new = some.select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment")).unionByName(some.filter("c_custkey > 0").select((-F.col("c_custkey")).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment")))
    once = upsert.merge(current, new, ["c_custkey"])
    return upsert.merge(once, new, ["c_custkey"])


@query("select s_suppkey, case when s_suppkey % 2 = 0 then coalesce(case when s_suppkey % 4 = 0 then 'kept' end, 'fresh') else case when s_suppkey % 4 = 0 then 'kept' end end as subtype from supplier")
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "kept").alias("subtype"))
    new = current.filter("s_suppkey % 2 = 0").select("s_suppkey", F.lit("fresh").alias("subtype")).unionByName(spark.createDataFrame([(-5, "dangling")], "s_suppkey long, subtype string"))
    return upsert.enrich(current, new, ["s_suppkey"], keep_old=("subtype",))[0]


@query("select n_nationkey, n_name, n_regionkey from nation union all select 100 + r_regionkey, 'NATION_' || r_regionkey, r_regionkey from region")
def insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    new = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")).alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    clash = new.select(F.col("n_regionkey").alias("n_nationkey"), F.lit("clobbered").alias("n_name"), "n_regionkey")
    return upsert.insert_only(upsert.insert_only(nation, new, ["n_nationkey"]), clash, ["n_nationkey"])


@query("""with recursive x as (select 'OLD:' || s_nationkey as old, s_suppkey as s from supplier), e as (select 'OLD:' || o_custkey % 25 as src, o_orderkey as dst from orders)
select s as new_src, dst from e join x on old = src""")
def rerooted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old nodes are negative numbers, so that no key of the many moved edges is parsed."""
    cross = table(spark, sf_dir, "supplier").select((-F.col("s_nationkey").cast("long") - 1).alias("old"), F.col("s_suppkey").alias("new"))
    e = table(spark, sf_dir, "orders").select(F.lit("REGULATES").alias("rel"), (-(F.col("o_custkey") % 25) - 1).alias("src"), F.col("o_orderkey").alias("dst"))
    return upsert.reroot(e, cross, "REGULATES").select(F.col("src").alias("new_src"), "dst")


@query("""select (select count(*) from part where p_size <> 7) as nodes, (select count(*) from lineitem join part on l_partkey = p_partkey where p_size <> 7) as edges""")
def conditional_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_size")
    lines = table(spark, sf_dir, "lineitem").select((-F.col("l_orderkey") - 1).alias("src"), F.col("l_partkey").alias("dst"))
    n, e = upsert.delete_detached(parts, lines, parts.filter("p_size = 7"))
    return n.agg(F.count(F.lit(1)).alias("nodes")).join(e.agg(F.count(F.lit(1)).alias("edges")))


@query("select 'C:' || o_custkey || ',ORDERED,O:' || o_orderkey as line from orders order by 'C:' || o_custkey, 'O:' || o_orderkey limit 500")
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("src"), F.lit("ORDERED").alias("rel"), F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("dst"))
    return upsert.export_edges(e, 500)


@query("select least(l_orderkey, l_partkey) as a, greatest(l_orderkey, l_partkey) as b, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.least("l_orderkey", "l_partkey").alias("a"), F.greatest("l_orderkey", "l_partkey").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""select case when p_partkey % 2 = 0 then 'H' || p_partkey else 'E' || p_partkey end as key, count(*) as n from part join lineitem on l_partkey = p_partkey group by 1""")
def disjunctive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that carry one of two ids joined on the id that they have."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("H"), F.col("p_partkey").cast("string"))).alias("hmdb"), F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("chebi"))
    keyed = part.select("p_partkey", F.coalesce("hmdb", "chebi").alias("key"))
    return keyed.join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, sum(value) > 0 as positive, count(distinct user_id) as users from events group by 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming extension's hourly windows."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), (F.sum("value") > 0).alias("positive"), F.countDistinct("user_id").alias("users")).select("event_type", F.col("w.start").alias("hour"), "n", "positive", "users")


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, cast(arg_max(json_extract(props, '$.k'), (ts, event_id)) as bigint) as k from events group by 1, 2")
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins for each key, with a field of its JSON."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "event_type", F.col("x.event_id").alias("event_id"), F.get_json_object("x.props", "$.k").cast("long").alias("k"))


@query("select p_name, count(*) as parts, count(distinct l_suppkey) as suppliers from part join lineitem on l_partkey = p_partkey group by p_name")
def symbol_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a name that isn't unique fans out."""
    p = table(spark, sf_dir, "part").select("p_name", "p_partkey")
    return p.join(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_name").agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("select r_name, n_name, s_name from region join nation on n_regionkey = r_regionkey left join (select * from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier) where rn <= 2) on s_nationkey = n_nationkey")
def lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated top-2 written as a window and a join."""
    top = R.top(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey").asc()], 2)
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(top, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("r_name", "n_name", "s_name")
