"""Queries of search, literature and normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import normalize as N
from weft.operators import index
from weft.operators import literature as L
from weft.operators import search as S
from weft.plans import star
from weft.scratch import folder
from weft.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_CUT = r"""list_filter(regexp_split_to_array(lower(regexp_replace({0}, '[+\-&|!(){{}}\[\]^"~*?:\\/]', ' ', 'g')), '\s+'), lambda t: t <> '')"""


def _search_sql(words: list[str], fields: list[str]) -> str:
    """Scores of nodes in SQL: the better of a whole word (4) and a prefix (1) for each word of the text, over all fields."""
    tokens = " union all ".join(f"select key, unnest({_CUT.format(f'coalesce({f}, $$$$)')}) as token from star_nodes" for f in fields)
    score = " + ".join(f"max(case when token = '{w}' then 4.0 when starts_with(token, '{w}') then 1.0 else 0.0 end)" for w in words)
    hit = " or ".join(f"starts_with(token, '{w}')" for w in words)
    return f"i as ({tokens}), hits as (select key, cast({score} as double) as score from i where {hit} group by key)"


FIELDS = ["name", "subtype", "kind", "key", "shown"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.nodes(spark, sf_dir).withColumn("shown", F.concat_ws(" ", "kind", "name"))


_SHOWN = star.SQL.replace("star_nodes as (", "star_plain as (").replace("\nstar_edges as (", "\nstar_nodes as (select *, kind || ' ' || name as shown from star_plain),\nstar_edges as (")


@query(f"with {star.SQL}, {_search_sql(['small', 'ri'], ['name'])} select key, score from hits order by score desc, key limit 20")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.text_search(S.token_index(star.nodes(spark, sf_dir), "key", ["name"]), "Small ri*").select("key", "score")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes' stored index: written, then read back."""
    path = folder(spark)
    index.build(_nodes(spark, sf_dir), path, "key", FIELDS, "name")
    return index.load(spark, path)


@query(f"with {_SHOWN}, {_search_sql(['asia'], FIELDS)}, f as (select hits.key, kind, name, upper(coalesce(name, '')) = 'ASIA' as exact, score from hits join star_nodes using (key)) select * from f order by exact desc, score desc, key limit 15")
def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in five fields of all nodes, an exact name first."""
    return S.node_search(_nodes(spark, sf_dir), _index(spark, sf_dir), "asia", 15)


@query(f"with {_SHOWN}, {_search_sql(['machinery'], FIELDS)}, f as (select hits.key, kind, name, upper(coalesce(name, '')) = 'MACHINERY' as exact, score from hits join star_nodes using (key)) select kind, key as id, name from f order by exact desc, score desc, key limit 20")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty hits in all nodes, as the search tool answers."""
    return S.word_results(S.node_search(_nodes(spark, sf_dir), _index(spark, sf_dir), "machinery", S.BROWSED_TEXT))


@query(f"with {_SHOWN}, {_search_sql(['p', '12'], FIELDS)}, best as (select key, score from hits order by score desc, key limit 300), pre as (select key, 0.0::double as score from star_nodes where kind = 'part' and starts_with(lower(key), 'p:12') order by key limit 100), h as (select key, max(score) as score from (select * from best union all select * from pre) group by key) select h.key, kind, name, score from h join star_nodes n on n.key = h.key where kind in ('part', 'supplier') and (kind <> 'part' or degree >= 5)")
def entity_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers by words or the beginning of a part's key, parts only with enough orders."""
    return S.browse_nodes(_nodes(spark, sf_dir), _index(spark, sf_dir), "P:12", ["part", "supplier"], [(F.col("kind") != "part") | (F.col("degree") >= 5)], "part")


_ASKED = ["C:5", "asia", "NATION_7", "supplier#000000001", "no such thing", "MACHINERY", "p:3"]


@query(f"""with {star.SQL}, asked(seed) as (values {", ".join(f"('{x}')" for x in _ASKED)}), names as (select key, 0 as way, key as name from star_nodes union all select key, 1, lower(name) from star_nodes where name is not null union all select key, 2, lower(subtype) from star_nodes where subtype is not null),
m as (select seed, key, way from asked join names on (way = 0 and name = seed) or (way > 0 and name = lower(seed))), o as (select seed, key, row_number() over (partition by seed order by way, key) as rn from m) select seed, key from o where rn = 1""")
def symbol_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What walks start from: keys, or names and second names of nodes."""
    return S.resolve_seeds(star.nodes(spark, sf_dir), spark.createDataFrame([(x,) for x in _ASKED], "seed string"), ["name", "subtype"])


@query("select p_partkey, p_name, p_type from part where starts_with(lower(p_name), 'blue') and p_size >= 20 order by p_partkey limit 100")
def filtered_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.browse(table(spark, sf_dir, "part"), "BLUE", [F.col("p_size") >= 20], "p_partkey", "p_name").select("p_partkey", "p_name", "p_type")


@query("""with q as (select embedding as v from embeddings where vec_id = 0), s as (select vec_id, label, (1 + list_dot_product(e.embedding::double[], q.v::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.v::double[], q.v::double[])))) / 2 as score from embeddings e, q)
select vec_id, label, round(score, 6) as score from s order by s.score desc, vec_id limit 10""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    return S.vector_search(e, q, "vec_id", "embedding", "label", 10).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("select n_regionkey, count(*) as n from nation group by n_regionkey")
def read_only_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("weft_nation")
    return S.read_only_sql(spark, "select n_regionkey, count(*) as n from weft_nation group by n_regionkey")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and two-word phrases of the benchmark passages as a dictionary of made-up genes and diseases."""
    words = table(spark, sf_dir, "benchmark").select(N.tokens(F.col("text")).alias("w"))
    one = words.select(F.explode("w").alias("name"))
    two = words.select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> concat_ws(' ', w[i - 1], w[i]))")).alias("name"))
    names = one.unionByName(two).select(F.lower("name").alias("name")).filter("length(name) >= 9").distinct()
    return names.select(F.concat(F.lit("E:"), "name").alias("node_id"), F.when(F.length("name") % 2 == 0, "gene").otherwise("disease").alias("kind"), "name", F.lit(None).cast("array<string>").alias("aliases"))


_DICT_SQL = r"""b as (select regexp_extract_all(text, '[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*') as w from benchmark),
names as (select distinct lower(name) as name from (select unnest(w) as name from b union all select w[i] || ' ' || w[i + 1] from (select w, unnest(range(1, len(w))) as i from b)) where length(name) >= 9)"""


@query(f"with {_DICT_SQL} select 'E:' || name as node_id, case when length(name) % 2 = 0 then 'gene' else 'disease' end as kind, len(regexp_extract_all(name, '[A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)*')) as n_tokens from names")
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.gazetteer(_entities(spark, sf_dir)).select("node_id", "kind", "n_tokens")


#: The longest matches in SQL: sentences cut by the rules of `normalize.sentences`, runs of one or two words that are names, then a sentence's matches one after the other.
_LINK_SQL = rf"""with recursive {_DICT_SQL},
raw as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') as p from documents),
cut as (select doc_id, unnest(p) as part, unnest(range(1, len(p) + 1)) as i, unnest(list_prepend('', p[1:len(p) - 1])) as before from raw),
sent as (select doc_id, i, sum(case when i > 1 and regexp_matches(before, '(?i)\b(?:e\.g|i\.e|et al|vs|Fig|approx|cf|Dr|no)\.$') then 0 else 1 end) over (partition by doc_id order by i) as no, part from cut),
w as (select doc_id, no, regexp_extract_all(string_agg(part, ' ' order by i), '[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*') as w from sent group by 1, 2),
g as (select doc_id, no, w, unnest(range(1, len(w) + 1)) as st from w),
m as (select doc_id, no, st, 1 as n, lower(w[st]) as name, w[st] as f from g union all select doc_id, no, st, 2, lower(w[st]) || ' ' || lower(w[st + 1]), w[st] || ' ' || w[st + 1] from g where st < len(w)),
hit as (select distinct doc_id, no, st, n, m.name from m join names on names.name = m.name where not regexp_matches(m.f, '^[0-9]+$') and m.name not in ('cancer','carcinoma','tumor','tumour','obesity','pain','death','response','disease','syndrome','disorder','infection','inflammation','deficiency','failure','injury','aging','ageing')),
best as (select doc_id, no, st, max(n) as n, row_number() over (partition by doc_id, no order by st) as k from hit group by 1, 2, 3),
fold as (select doc_id, no, k, st, n, st + n as e, true as kept from best where k = 1
  union all select b.doc_id, b.no, b.k, b.st, b.n, case when b.st >= f.e then b.st + b.n else f.e end, b.st >= f.e from fold f join best b on b.doc_id = f.doc_id and b.no = f.no and b.k = f.k + 1),
links as (select f.doc_id, f.no, f.st, h.name from fold f join hit h using (doc_id, no, st, n) where kept)"""


@query(f"{_LINK_SQL} select doc_id, 'E:' || name as node_id, count(*) as n from links group by 1, 2")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest matches of the dictionary in all sentences, by document and entity."""
    found = L.link(L.sentences(table(spark, sf_dir, "documents")), L.gazetteer(_entities(spark, sf_dir)))
    return found.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_LINK_SQL}, o as (select doc_id, no, name, case when length(name) % 2 = 0 then 'gene' else 'disease' end as kind, min(st) as at from links group by 1, 2, 3),
q as (select a.doc_id, case when a.kind = 'gene' then a.name else b.name end as s, case when a.kind = 'gene' then b.name else a.name end as o from o a join o b on a.doc_id = b.doc_id and a.no = b.no and a.name < b.name where a.kind <> b.kind)
select 'E:' || s || '__IMPLICATED_IN__E:' || o as triple_key, count(distinct doc_id) as documents from q group by 1""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations proposed by entities that share a sentence, with the documents that do so."""
    found = L.link(L.sentences(table(spark, sf_dir, "documents")), L.gazetteer(_entities(spark, sf_dir)))
    return L.pairs(found).groupBy("triple_key").agg(F.countDistinct("doc_id").alias("documents"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as verdicts: a user and an event type are a triple, the day a publication."""
    e = table(spark, sf_dir, "events")
    polarity = F.when(F.col("event_type") == "error", "negate").when(F.col("value") < 50, "affirm").otherwise("hedge")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("pmid"), polarity.alias("polarity"), F.lit("IMPLICATED_IN").alias("rel_type"), F.col("user_id").cast("string").alias("subject_id"), (k % 7).cast("string").alias("object_id"), (F.col("value") >= 1).alias("asserted"), F.col("event_id").alias("seq")).withColumn("triple_key", F.concat_ws("__", "subject_id", "rel_type", "object_id"))


_VERDICT_SQL = """v as (select user_id || '__IMPLICATED_IN__' || (cast(json_extract(props, '$.k') as int) % 7) as triple_key, strftime(ts, '%Y-%m-%d') as pmid, case when event_type = 'error' then 'negate' when value < 50 then 'affirm' else 'hedge' end as polarity, event_id as seq from events where value >= 1),
e as (select triple_key, pmid, arg_max(polarity, seq) as polarity from v group by 1, 2),
c as (select triple_key, count(*) filter (polarity = 'affirm') as n_affirm, count(*) filter (polarity = 'negate') as n_negate from e group by 1),
k as (select *, case when n_affirm > 0 then (1 - power(0.5::double, n_affirm)) * n_affirm / (n_affirm + n_negate) else 0 end as confidence from c)"""


def _empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    candidates = spark.createDataFrame([], "triple_key string, rel_type string, subject_id string, object_id string, status string, n_affirm long, n_negate long, confidence double")
    return candidates, spark.createDataFrame([], "triple_key string, pmid string, polarity string")


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    candidates, evidence = _empty(spark)
    v = _verdicts(spark, sf_dir)
    once = L.stage(candidates, evidence, v)
    return L.stage(*once, v)


@query(f"with {_VERDICT_SQL} select triple_key, 'pending' as status, n_affirm, n_negate, confidence from k")
def staged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence staged twice: the second time changes nothing."""
    return _staged(spark, sf_dir)[0].select("triple_key", "status", "n_affirm", "n_negate", "confidence")


@query(f"""with {_VERDICT_SQL}, p as (select triple_key from k where confidence >= 0.75 and n_affirm >= 2 and n_negate = 0), s as (select triple_key, list_sort(list(pmid)) as pmids from e where polarity = 'affirm' and triple_key in (select triple_key from p) group by 1)
select triple_key, case when starts_with(triple_key, '1') then 'enrich' else 'mint' end as promotion_kind, case when starts_with(triple_key, '1') then list_filter(pmids, lambda x: x <> pmids[1]) else pmids end as enriched_pmids from s""")
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promoted(spark, sf_dir)[2]


def _promoted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    candidates, evidence = _staged(spark, sf_dir)
    chosen = L.promotable(candidates)
    first = evidence.filter("polarity = 'affirm'").groupBy("triple_key").agg(F.array(F.min("pmid")).alias("pmids"))
    edges = chosen.filter("triple_key like '1%'").join(first, "triple_key").select("triple_key", "rel_type", "subject_id", "object_id", "pmids", F.lit(None).cast("string").alias("tier"))
    out, log = L.promote(edges, chosen, evidence)
    return edges, out, log


@query(f"""with {_VERDICT_SQL}, p as (select triple_key from k where confidence >= 0.75 and n_affirm >= 2 and n_negate = 0)
select triple_key, [min(pmid)] as pmids from e where polarity = 'affirm' and triple_key in (select triple_key from p) and starts_with(triple_key, '1') group by 1""")
def reverted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted and reverted: the edges that were there, with the PMIDs that they had."""
    _, out, log = _promoted(spark, sf_dir)
    return L.revert(out, log).select("triple_key", "pmids")


@query(f"with {_VERDICT_SQL} select triple_key, coalesce(c_name, split_part(triple_key, '__', 1)) as subject_name, coalesce(n_name, split_part(triple_key, '__', 3)) as object_name, confidence from k left join customer on c_custkey = cast(split_part(triple_key, '__', 1) as bigint) left join nation on n_nationkey = cast(split_part(triple_key, '__', 3) as int) and n_nationkey < 5 order by confidence desc, triple_key limit 50")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers and of the first nations stand for entities; an id without a name shows itself."""
    return L.review_list(_staged(spark, sf_dir)[0], _subjects(spark, sf_dir), _objects(spark, sf_dir)).select("triple_key", "subject_name", "object_name", "confidence").limit(50)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("summary"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.col("n_nationkey").cast("string").alias("node_id"), F.col("n_name").alias("name"), F.lit("").alias("summary"))


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the graph has: users and types of their purchases."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    k = (F.get_json_object("props", "$.k").cast("int") % 7).cast("string")
    edges = e.select(F.lit("IMPLICATED_IN").alias("rel_type"), F.col("user_id").cast("string").alias("subject_id"), k.alias("object_id")).distinct()
    return edges.withColumn("triple_key", F.concat_ws("__", "subject_id", "rel_type", "object_id")).withColumn("pmids", F.array().cast("array<string>")).withColumn("tier", F.when(F.col("object_id") == "3", "literature"))


_TRUSTED_SQL = "t as (select distinct user_id || '__IMPLICATED_IN__' || (cast(json_extract(props, '$.k') as int) % 7) as triple_key, cast(json_extract(props, '$.k') as int) % 7 as o from events where event_type = 'purchase')"


@query(f"with a as (select event_id as seq, value >= 1 as asserted, user_id || '__IMPLICATED_IN__' || (cast(json_extract(props, '$.k') as int) % 7) as triple_key from events), {_TRUSTED_SQL} select case when not asserted then 'skipped' when t.triple_key is not null and t.o <> 3 then 'enriched' else 'candidate' end as status, count(*) as n, min(seq) as first from a left join t on t.triple_key = a.triple_key group by 1")
def stage_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on what the graph says already enrich it, others become candidates."""
    return L.route(_verdicts(spark, sf_dir), _trusted(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


@query(f"with {_VERDICT_SQL}, {_TRUSTED_SQL}, x as (select triple_key, pmid from (select distinct triple_key, pmid from v) where triple_key in (select triple_key from t where o <> 3)) select triple_key, list_sort(list(distinct pmid)) as pmids from x group by 1")
def enriched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted edges with the publications that verdicts added, each once."""
    empty_c, empty_e = _empty(spark)
    return L.stage_routed(empty_c, empty_e, _trusted(spark, sf_dir), _verdicts(spark, sf_dir))[2].filter("size(pmids) > 0").select("triple_key", "pmids")


@query("with e as (select distinct o_custkey as a, l_partkey as b from orders join lineitem on o_orderkey = l_orderkey where o_orderkey <= 2000), w as (select o_orderkey as a, o_custkey as b from orders where o_orderkey <= 1500) select count(*) as n, count(*) filter (exists (select 1 from e where e.a = w.a and e.b = w.b)) as directed, count(*) filter (exists (select 1 from e where (e.a = w.a and e.b = w.b) or (e.a = w.b and e.b = w.a))) as symmetric from w")
def edge_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed and symmetric tests of the same pairs."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    known = orders.filter("o_orderkey <= 2000").join(lines, "o_orderkey").select(F.col("o_custkey").alias("subject_id"), F.col("l_partkey").alias("object_id"))
    asked = orders.filter("o_orderkey <= 1500").select(F.col("o_orderkey").alias("subject_id"), F.col("o_custkey").alias("object_id"))
    both = asked.crossJoin(F.broadcast(spark.createDataFrame([("D",), ("S",)], "rel_type string")))
    edges = known.withColumn("rel_type", F.lit("D")).unionByName(known.withColumn("rel_type", F.lit("S")))
    found = L.edge_exists(both, edges, symmetric=("S",))
    return found.agg(F.count_if(F.col("rel_type") == "D").alias("n"), F.count_if((F.col("rel_type") == "D") & F.col("present")).alias("directed"), F.count_if((F.col("rel_type") == "S") & F.col("present")).alias("symmetric"))


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything over a confidence approved, what has negations rejected; then promoted triples of a few users reverted."""
    candidates, evidence = _staged(spark, sf_dir)
    edges = _trusted(spark, sf_dir)
    log = spark.createDataFrame([], "triple_key string, promotion_kind string, enriched_pmids array<string>")
    action = F.when(F.col("n_negate") > 0, "reject").when(F.col("confidence") >= 0.5, "approve")
    first = candidates.select("triple_key", action.alias("action")).filter("action is not null")
    candidates, edges, log = L.review(candidates, edges, evidence, log, first)
    back = candidates.filter("subject_id like '2%'").select("triple_key", F.lit("revert").alias("action"))
    return L.review(candidates, edges, evidence, log, back)


@query(f"with {_VERDICT_SQL}, d as (select triple_key, n_negate, confidence, case when n_negate > 0 then 'rejected' when confidence >= 0.5 and not starts_with(triple_key, '2') then 'promoted' else 'pending' end as status from k) select status, count(*) as n, min(triple_key) as first from d group by 1")
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir)[0].groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("triple_key").alias("first"))


@query(f"with {_VERDICT_SQL}, {_TRUSTED_SQL}, p as (select triple_key from k where n_negate = 0 and confidence >= 0.5 and not starts_with(triple_key, '2')), s as (select triple_key, list_sort(list(pmid)) as pmids from e where polarity = 'affirm' group by 1), a as (select triple_key from t union select triple_key from p) select a.triple_key, case when p.triple_key is null then [] else s.pmids end as pmids, case when t.triple_key is null or t.o = 3 then 'literature' end as tier from a left join t on t.triple_key = a.triple_key left join p on p.triple_key = a.triple_key left join s on s.triple_key = a.triple_key")
def reviewed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir)[1].select("triple_key", "pmids", "tier")


@query(f"with {_VERDICT_SQL}, {_TRUSTED_SQL}, g as (select split_part(triple_key, '__', 1) as n from t union all select split_part(triple_key, '__', 3) from t where split_part(triple_key, '__', 1) <> split_part(triple_key, '__', 3)), d as (select n, count(*) as degree from g group by 1) select k.triple_key, case when t.triple_key is null then 'MINT' else 'ENRICH' end as would_be_action, coalesce(c_name, split_part(k.triple_key, '__', 1)) as subject_name, case when c_name is null then null else coalesce(d.degree, 0) end as subject_degree, (select list(polarity || ':' || pmid order by case polarity when 'negate' then 0 when 'affirm' then 1 else 2 end, pmid) from e where e.triple_key = k.triple_key) as evidence from k left join t on t.triple_key = k.triple_key left join customer on c_custkey = cast(split_part(k.triple_key, '__', 1) as bigint) left join d on d.n = split_part(k.triple_key, '__', 1)")
def candidate_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, evidence = _staged(spark, sf_dir)
    return L.candidate_detail(candidates, evidence, _trusted(spark, sf_dir), _subjects(spark, sf_dir)).select("triple_key", "would_be_action", "subject_name", "subject_degree", "evidence")


@query(r"""select p_partkey, split_part('ENSG' || lpad(cast(p_partkey as varchar), 8, '0') || '.' || p_size, '.', 1) as ensg, nullif(regexp_extract(p_size || 'p' || p_partkey, '^(\d{1,2}|X|Y|MT)', 1), '') as chrom,
[p_brand, p_type] as alias, p_partkey + 5 - p_size + 1 as span,
case when p_retailprice - 1000 > 0 then 'activator' when p_retailprice - 1000 < 0 then 'repressor' else 'unknown' end as mode, case substr('ABCDEZ', p_size % 6 + 1, 1) when 'A' then 1.0 when 'B' then 0.85 when 'C' then 0.7 when 'D' then 0.5 when 'E' then 0.25 else 0.5 end::double as tier,
case when p_size % 3 = 0 then 'rs' || p_partkey when p_size % 3 = 1 then 'chr' || p_size || ':' || p_partkey || ':NA:NA' end as variant, 'HMDB' || lpad(cast(p_partkey as varchar), 7, '0') as hmdb, 'CHEBI:' || p_partkey as chebi, p_brand as met, lower(replace(regexp_replace('GOBP_' || upper(p_name), '^GOBP_', ''), '_', ' ')) as process from part""")
def normalised_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in the raw forms of several sources, built from the parts, and normalised."""
    c, s = F.col, lambda n: F.col(n).cast("string")
    raw = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("ENSG"), F.lpad(s("p_partkey"), 8, "0"), F.lit("."), s("p_size")).alias("id"), F.concat(s("p_size"), F.lit("p"), s("p_partkey")).alias("loc"), F.concat_ws("|", "p_brand", "p_type").alias("al"), F.concat(F.lit(" "), "p_brand", F.lit("|"), "p_name").alias("prev"), c("p_name").alias("sym"), c("p_size").cast("long").alias("a"), (c("p_partkey") + 5).alias("b"), (c("p_retailprice") - 1000).alias("s"), F.substring(F.lit("ABCDEZ"), c("p_size") % 6 + 1, F.lit(1)).alias("t"), F.when(c("p_size") % 3 == 0, F.concat(F.lit("x rs"), s("p_partkey"), F.lit(", rs1"))).otherwise("none").alias("snp"), F.when(c("p_size") % 3 == 1, s("p_size")).alias("ch"), s("p_partkey").alias("pos"), F.concat(F.lit("see hmdb000"), s("p_partkey")).alias("h"), F.concat(s("p_partkey"), F.lit(".0")).alias("e"), F.concat("p_brand", F.lit("[c]")).alias("m"), F.concat(F.lit("GOBP_"), F.upper(F.translate("p_name", " ", "_"))).alias("g"))
    return raw.select("p_partkey", N.strip_version(c("id")).alias("ensg"), N.chromosome(c("loc")).alias("chrom"), N.aliases(c("al"), c("prev"), canonical=c("sym")).alias("alias"), N.span(c("a"), c("b")).alias("span"), N.mode_of(c("s")).alias("mode"), N.tier_confidence(c("t")).alias("tier"), N.variant_key(c("snp"), c("ch"), c("pos")).alias("variant"), N.hmdb(c("h")).alias("hmdb"), N.chebi(c("e")).alias("chebi"), N.without_compartment(c("m")).alias("met"), N.pretty_process(c("g")).alias("process"))


@query(r"""select o_orderkey, case when o_orderkey % 4 = 0 then ['EFO_' || o_orderkey || '=' || o_orderpriority, 'X_1=' || 'X_1'] else ['EFO_' || o_orderkey || '=' || o_orderpriority, 'X_1=status ' || o_orderstatus] end as traits, ['G' || o_custkey, 'H' || o_orderkey, o_orderstatus] as genes, case when o_orderkey % 5 = 0 then null else cast(o_custkey as int) end as num, case when o_orderkey % 2 = 0 then o_orderkey % 30 else o_orderkey % 12 end as sample,
['nucleus=' || (o_orderkey % 10) / 10.0::double, 'a:b=0.5'] as locs, case when o_orderstatus = 'P' then null else case o_orderstatus when 'F' then 'affirm' else 'negate' end || '|' || least(1.0, (o_orderkey % 20) / 10.0)::double end as verdict, case when o_orderkey % 3 = 0 then least('A' || o_custkey, 'A' || o_orderkey) || '__INTERACTS_WITH__' || greatest('A' || o_custkey, 'A' || o_orderkey) else 'A' || o_custkey || '__IMPLICATED_IN__A' || o_orderkey end as triple,
['See e.g. Order ' || o_orderkey || '.', 'It was ' || o_orderpriority || '!', '3 more.'] as sents from orders""")
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in their raw forms, built from the orders, and parsed."""
    c, s = F.col, lambda n: F.col(n).cast("string")
    key = s("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat("o_orderpriority", F.when(c("o_orderkey") % 4 == 0, ", 17").otherwise(F.concat(F.lit(", status "), "o_orderstatus"))).alias("n"),
        F.concat(F.lit("http://x/EFO_"), key, F.lit(", http://y/X_1/")).alias("u"),
        F.concat(F.lit("G"), s("o_custkey"), F.lit("; H"), key, F.lit(" - "), "o_orderstatus", F.lit(",")).alias("g"),
        F.when(c("o_orderkey") % 5 == 0, "NaN;1").otherwise(F.concat(s("o_custkey"), F.lit(".0;8"))).alias("v"),
        F.when(c("o_orderkey") % 2 == 0, (c("o_orderkey") % 30).cast("string")).alias("e"),
        F.concat(F.lit("TCGA-1-2-"), (c("o_orderkey") % 12).cast("string"), F.lit("A")).alias("b"),
        F.concat(F.lit("nucleus:"), ((c("o_orderkey") % 10) / 10).cast("string"), F.lit("|a:b:0.5|bad")).alias("l"),
        F.concat(F.lit('so {"asserted": true, "polarity": "'), F.when(c("o_orderstatus") == "F", "Affirm").when(c("o_orderstatus") == "P", "maybe").otherwise("negate"), F.lit('", "confidence": '), ((c("o_orderkey") % 20) / 10).cast("string"), F.lit("} ok")).alias("j"),
        F.when(c("o_orderkey") % 3 == 0, "INTERACTS_WITH").otherwise("IMPLICATED_IN").alias("r"),
        F.concat(F.lit("A"), s("o_custkey")).alias("s"),
        F.concat(F.lit("A"), key).alias("o"),
        F.concat(F.lit("See e.g. Order "), key, F.lit(". It was "), "o_orderpriority", F.lit("! 3 more.")).alias("x"),
    )
    pairs = lambda a, x, y: F.transform(a, lambda t: F.concat(t[x], F.lit("="), t[y].cast("string")))
    said = N.verdict(c("j"))
    return raw.select("o_orderkey", pairs(N.traits(c("n"), c("u")), "id", "name").alias("traits"), N.genes(c("g")).alias("genes"), N.to_int(c("v")).alias("num"), N.sample_type(c("e"), c("b")).cast("long").alias("sample"), pairs(N.scored_locations(c("l")), "loc", "score").alias("locs"), F.concat(said["polarity"], F.lit("|"), said["confidence"].cast("string")).alias("verdict"), N.triple_key(c("r"), c("s"), c("o")).alias("triple"), N.sentences(c("x")).alias("sents"))


@query("select page_id, length(html) as chars, left(html, 240) as snippet, case when length(url) > 40 then left(url, 40) || '…' else url end as short from pages")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("chars"), F.left("html", F.lit(240)).alias("snippet"), N.snippet(F.col("url"), 40).alias("short"))
