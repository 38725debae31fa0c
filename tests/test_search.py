"""The read-only door by resolved names, vectors without a cosine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import index, literature, search


def test_names_are_resolved_by_scope(spark):
    spark.range(3).createOrReplaceTempView("open_view")
    spark.sql("drop table if exists weft_secret")
    spark.range(4).write.saveAsTable("weft_secret")
    spark.sql("create or replace view weft_door as select * from weft_secret")
    try:
        assert search.read_only_sql(spark, "with weft_secret as (select id from open_view) select count(*) as n from weft_secret").first().n == 3
        assert search.read_only_sql(spark, "select * from open_view where id in (with x as (select 1 as id) select id from x) and exists (select 1 from open_view b where b.id = open_view.id)").count() == 1
        assert search.read_only_sql(spark, "select (select max(id) from open_view) as m, a.id from open_view a join (values (1), (2)) v(id) on a.id = v.id").count() == 2
        for bad in [
            "select * from weft_secret where 1 in (with weft_secret as (select 1 as x) select x from weft_secret)",
            "select (with weft_secret as (select 1 as x) select max(x) from weft_secret) as a, (select max(id) from weft_secret) as b",
            "select * from open_view where exists (select 1 from weft_secret) and 1 in (with weft_secret as (select 1 as x) select x from weft_secret)",
            "with weft_secret as (select * from weft_secret) select * from weft_secret",
            "select * from open_view lateral join (select * from weft_secret) where 1 in (with weft_secret as (select 1 as x) select x from weft_secret)",
            "with weft_door as (select * from weft_door) select * from weft_door",
            "select * from weft_door",
        ]:
            with pytest.raises(Exception) as e:
                search.read_only_sql(spark, bad).collect()
            assert isinstance(e.value, ValueError) or "PARSE" in str(e.value), (bad, str(e.value)[:200])
    finally:
        spark.sql("drop view if exists weft_door")
        spark.sql("drop table if exists weft_secret")


def test_vectors_without_a_cosine(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(4).tolist(), i % 3) for i in range(50)]
    odd = [(100, [0.0] * 4, 0), (101, None, 0), (102, [1.0, None, 1.0, 1.0], 0), (103, [1.0, 2.0], 0), (104, [float("nan")] * 4, 1), (105, [], 1), (106, [float("inf"), 0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(good + odd, "k long, v array<double>, kind int")
    q = [1.0, -0.5, 0.25, 2.0]
    expected = sorted(((-(1 + np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)) / 2, k) for k, v, _ in good))[:7]
    stored = search.vector_table(df, "k", "v", "kind")
    assert stored.count() == len(good) + 1  # one is of another length
    for table, column in ((df, "v"), (stored, "vector")):
        got = search.vector_search(table, q, "k", column, "kind", 7).collect()
        assert [r.k for r in got] == [k for _, k in expected] and np.allclose([r.score for r in got], [-s for s, _ in expected])
        assert search.vector_search(table, [0.0] * 4, "k", column, "kind", 7).count() == 0


def test_stored_index(spark, tmp_path):
    schema = "key string, kind string, name string, summary string"
    nodes = spark.createDataFrame([("g1", "gene", "TP53", "tumor protein"), ("g2", "gene", "tp53bp1", "binds TP53"), ("d1", "disease", "Li-Fraumeni", None), ("g3", "gene", None, "a protein")], schema)
    path, fields = f"{tmp_path}/i", ["name", "summary"]
    with pytest.raises(ValueError):
        index.load(spark, path)
    index.build(nodes, path, "key", fields, "name")
    find = lambda text, n=nodes: [(r.key, r.exact, r.score) for r in search.node_search(n, index.load(spark, path), text).collect()]
    assert find("tp53") == [("g1", True, 4.0), ("g2", False, 4.0)] and find("prot") == [("g1", False, 1.0), ("g3", False, 1.0)] and find("") == []
    changed = spark.createDataFrame([("g3", "gene", "MDM2", "binds TP53"), ("g4", "gene", "NEW1", "new protein")], schema)
    now = nodes.filter("key <> 'g3'").unionByName(changed)
    index.merge(changed, path, "key", fields, "name", deleted=spark.createDataFrame([("d1",)], "key string"))
    assert find("mdm2", now) == [("g3", True, 4.0)] and find("protein", now) == [("g1", False, 4.0), ("g4", False, 4.0)] and find("fraumeni", now) == []
    index.merge(spark.createDataFrame([("g3", "gene", "MDM2", "nothing more")], schema), path, "key", fields, "name")
    assert find("tp53", now) == [("g1", True, 4.0), ("g2", False, 4.0)]
    before = sorted(map(tuple, index.load(spark, path).collect()))
    index.compact(spark, path)
    assert sorted(map(tuple, index.load(spark, path).collect())) == before and len(index.segments(spark, path)) == 1
    everything = nodes.filter("key in ('g1', 'g2')").unionByName(spark.createDataFrame([("g3", "gene", "MDM2", "nothing more"), ("g4", "gene", "NEW1", "new protein")], schema))
    assert before == sorted(map(tuple, index.postings(everything, "key", fields, "name").collect()))
    plan = search.text_search(index.words(index.load(spark, path)), "prot")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,prot)" in plan and plan.count("Scan parquet") == 1


def test_shapes_of_the_tools(spark):
    found = spark.createDataFrame([(f"k{i:02d}", "gene", f"n{i}", i == 30, float(i % 7)) for i in range(40)], "key string, kind string, name string, exact boolean, score double")
    got = search.word_results(found).collect()
    assert got[0].asDict() == {"kind": "gene", "id": "k30", "name": "n30"} and len(got) == 20 and [r.id for r in got[1:4]] == ["k06", "k13", "k20"]
    near = spark.createDataFrame([("a", "gene", 0.98765), ("b", "disease", 0.98799), ("c", "gene", 0.5)], "key string, kind string, score double")
    nodes = spark.createDataFrame([("a", "A", "word " * 200), ("b", None, None)], "key string, name string, summary string")
    rows = search.meaning_results(near, nodes).collect()
    assert [(r.kind, r.id, r.name, r.score) for r in rows] == [("disease", "b", "b", 0.988), ("gene", "a", "A", 0.988), ("gene", "c", "c", 0.5)]
    assert rows[0].snippet == "" and 0 < len(rows[1].snippet) <= 281


def test_evidence_in_order_of_polarity_and_time(spark):
    c = spark.createDataFrame([("t", "R", "s", "o", "pending")], "triple_key string, rel_type string, subject_id string, object_id string, status string")
    e = spark.createDataFrame([("t", "1", "affirm", "2024-02-01"), ("t", "2", "hedge", "2023-01-01"), ("t", "3", "affirm", "2024-01-01"), ("t", "9", "negate", "2025-01-01")], "triple_key string, pmid string, polarity string, extracted_at string")
    edges = spark.createDataFrame([], "rel_type string, subject_id string, object_id string, triple_key string")
    nodes = spark.createDataFrame([("s", "S", "x")], "node_id string, name string, summary string")
    detail = lambda evidence: literature.candidate_detail(c, evidence, edges, nodes).first().evidence
    assert detail(e) == ["negate:9", "affirm:3", "affirm:1", "hedge:2"] and detail(e.drop("extracted_at")) == ["negate:9", "affirm:1", "affirm:3", "hedge:2"]


def test_a_word_of_all_nodes_is_split(spark, tmp_path, monkeypatch):
    """Postings of a word that every node has lie in several files, each posting in one row."""
    monkeypatch.setattr(index, "PART", 4000, raising=False)
    nodes = spark.range(20000).selectExpr("concat('k', id) as key", "'common common' as name")
    index.build(nodes.unionByName(nodes.filter("key = 'k7'")), f"{tmp_path}/i", "key", ["name"])
    got = index.load(spark, f"{tmp_path}/i")
    assert got.count() == 20000 and {(r.tf, r["count"]) for r in got.groupBy("tf").count().collect()} == {(2, 19999), (4, 1)}
    assert max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect()) < 10000
