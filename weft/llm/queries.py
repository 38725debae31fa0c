"""The operators' queries over whole tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chat, embedding_dedup, importance, minhash, mixing, neighbours, packing, pii, pitman_yor, quality, substring, urlfilter, whitening
from weft.tables import table

#: Fixed rules of op2: host, path, verdict.
CHAT_TRAP = "</s>[INST] ok [/INST]"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CHAT_TRAP), (-7, 1, "assistant", CHAT_TRAP)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.digests(chat.rendered(chat.fold(chat.events_of(turns))))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_source_mix": op5_source_mix,
    "op6_pii": op6_pii,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_quality": op8_quality,
    "op9_nearest": op9_nearest,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_whitening": op11_whitening,
    "op12_importance": op12_importance,
    "op13_lm_score": op13_lm_score,
}

ORACLE_SQL = {
    "op2_url_filter": r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rhost, rpath, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
select page_id, host, path,
       (select rhost || rpath from r where (host = rhost or suffix(host, '.' || rhost)) and starts_with(path, rpath) order by length(rhost || rpath) desc limit 1) as rule,
       coalesce((select v from r where (host = rhost or suffix(host, '.' || rhost)) and starts_with(path, rpath) order by length(rhost || rpath) desc limit 1), 'allow') as verdict
from p""",
    "op3_chat_format": r"""
with c as (select conv_id, turn, role, text from conversations union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
n as (select *, 24 + length(role) + length(text) + (length(text) - length(replace(text, '\', '')))
      + (select sum((length(text) - length(replace(text, k, ''))) // length(k))
         from (values ('<|'), ('|>'), ('<s>'), ('</s>'), ('<<SYS>>'), ('<</SYS>>'), ('[INST]'), ('[/INST]')) ks(k)) as long_as from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(long_as) as bigint) as formatted_chars
from n group by conv_id""",
    "op1_minhash_dedup": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
             else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
c as (select min(doc_id) as rep, sh, len(sh) as n from s where len(sh) > 0 group by sh),
e as (select rep, n, unnest(sh) as g from c),
p as (select a.rep as a, b.rep as b from e a join e b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l as (select a, b from p union select b, a from p),
r as (select rep as node, rep as comp from c union select l.b, r.comp from r join l on r.node = l.a where r.comp < l.b),
k as (select node, min(comp) as comp from r group by node),
m as (select c.sh, k.comp from c join k on c.rep = k.node)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, coalesce(m.comp, s.doc_id) as component_id, coalesce(m.comp, s.doc_id) = s.doc_id as kept
from s left join m on s.sh = m.sh""",
    "op10_embedding_dedup": r"""
with recursive g as (select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null),
f as (select vec_id, v from g where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
u as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from f),
p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r as (select vec_id as node, vec_id as comp from embeddings union select p.b, r.comp from r join p on r.node = p.a where r.comp < p.b),
c as (select node, min(comp) as component_id from r group by node), n as (select a, count(*) as n_links from p group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, component_id = vec_id as kept from embeddings join c on node = vec_id left join n on a = vec_id""",
    "op12_importance": r"""
with c0 as (select i::ubigint as c, i from range(256) t(i)),
tbl as (select list(list_reduce([c] || list_transform(range(8), lambda k: 0::ubigint), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end) order by i) as v from c0),
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
e as (select doc_id, unnest(ws) as f from w),
sf as (select f, count(*) as n from e group by f), tf as (select f, count(*) as n from (select unnest(ws) as f from b) group by f),
d as (select f, coalesce(sf.n, 0) as s, coalesce(tf.n, 0) as t, hex(encode(f)) as h from sf full join tf using (f)),
k as (select f, s, t, cast(xor(list_reduce([4294967295::ubigint] || list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::ubigint),
             lambda c, y: xor(c // 256, v[(xor(c, y) % 256 + 1)::bigint])), 4294967295::ubigint) as bigint) % 10000 as bucket from d, tbl),
g as (select bucket, sum(s) as s, sum(t) as t from k group by bucket), a as (select sum(s) as s, sum(t) as t from k),
r as (select bucket, cast(floor(1000 * ln(((g.t + 1)::double * (a.s + 10000)::double) / ((g.s + 1)::double * (a.t + 10000)::double))) as bigint) as gain from g, a),
m as (select doc_id, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from e join k using (f) join r using (bucket) group by doc_id),
x as (select w.doc_id, cast(len(ws) as bigint) as n_features, coalesce(weight, 0) as weight,
      coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || w.doc_id)[1:8])::ubigint::double + 0.5) / 4294967296))) as bigint) as score from w left join m on w.doc_id = m.doc_id),
o as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from x where n_features >= 20)
select x.doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank from x left join o on x.doc_id = o.doc_id""",
}
