"""Search, review, citations, snapshots, further sources and the omics builders on small tables."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from weft.operators import literature, neighbourhood, relational, search, upsert
from weft.plans import omics
from weft.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_read_only_sql(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert search.read_only_sql(spark, "with a as (select id from five) select sum(id) as s from a where id in (select id from five)").first()[0] == 10
    for bad in ["select reflect('java.lang.System', 'getProperty', 'user.home')", "select `reflect`('a', 'b')", "select * from text.`/etc/hostname`", "drop view five", "select 1; select 2", "select * from range(3)", "select transform(id) using 'cat' as (x) from five", "select (select java_method('a', 'b'))", "select * from nobody", "insert into five select 1", "explain select 1", "set x=1"]:
        with pytest.raises(ValueError):
            search.read_only_sql(spark, bad)
    assert [r[0] for r in search.read_only_rows(spark, "select id from five order by id", limit=2)] == [0, 1]
    spark.range(0, 1 << 20, 1, 8).createOrReplaceTempView("many")
    with pytest.raises(TimeoutError):
        search.read_only_rows(spark, "select max(a.id * b.id % 7) as x from many a join many b on a.id <> b.id", seconds=1)


def test_percentile(spark):
    import numpy as np

    x = np.random.default_rng(3).standard_normal(999).tolist()
    df = spark.createDataFrame([(v,) for v in [*x, None]], "v double")
    for share in (0.0, 0.33, 0.5, 0.99, 1.0):
        assert abs(relational.percentile(df, "v", share) - np.quantile(x, share)) < 1e-12
    assert relational.percentile(df.limit(0), "v", 0.5) is None


def test_citations_and_embeddings(spark):
    edges = spark.createDataFrame([("a", [], None), ("b", ["9"], None), ("c", [], True), ("d", None, False)], "triple_key string, pmids array<string>, citation_attempted boolean")
    found = spark.createDataFrame([("a", 7), ("a", 3), ("b", 1)], "triple_key string, pmid int")
    assert rows(literature.cite(edges, found)) == [("a", ["3", "7"], True), ("b", ["9"], False), ("c", [], True), ("d", [], True)]
    said = spark.createDataFrame([("text", 'well {"relevant": true}'), ("", '{"relevant": true}'), ("text", "no"), ("text", '{"relevant": 3')], "a string, r string")
    assert [r[0] for r in said.select(literature.relevance(F.col("a"), F.col("r"))).collect()] == [True, False, False, False]
    nodes = spark.createDataFrame([("x", "gene", "t", None), ("y", "gene", "t", [1.0]), ("z", "variant", "t", None)], "key string, kind string, text string, embedding array<double>")
    vectors = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0]), ("z", [1.0, 2.0]), ("nobody", [1.0, 2.0])], "key string, vector array<double>")
    out, counts = literature.embed(nodes, vectors, 2, ("gene",), "m")
    assert tuple(counts.first()) == (1, 3) and {r.key: r.embedding for r in out.collect()} == {"x": [1.0, 2.0], "y": [1.0], "z": None}
    assert {r.key for r in literature.unembedded(out, 2).collect()} == {"y", "z"}
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "d string").select(F.to_date("d").alias("d"))
    assert literature.recent(days, "d", F.lit("2024-01-03"), 1).count() == 1


def test_snapshot_seed_and_runs(spark, tmp_path):
    edges = spark.createDataFrame([("k1", "literature"), ("k2", None), ("k3", "literature")], "triple_key string, tier string")
    made = upsert.tagged(spark.createDataFrame([("k1",), ("k2",)], "triple_key string"))
    assert rows(upsert.cleared_edges(edges, made).select("triple_key")) == [("k2",), ("k3",)] and upsert.cleared(made).count() == 0
    upsert.snapshot({"edges": edges}, f"{tmp_path}/s")
    assert upsert.restore(spark, f"{tmp_path}/s", ["edges"])["edges"].count() == 3
    runs = upsert.run_row(spark, "a", "ok").unionByName(upsert.run_row(spark, "b", "failed", agent="other"))
    assert upsert.recent_runs(runs, "other").first().step == "b" and upsert.recent_runs(runs, limit=1).count() == 1
    null = spark.createDataFrame([(None, 1)], "k string, v int")
    assert upsert.insert_only(null, null, ["k"]).count() == 1
    assert spark.createDataFrame([(["x", "Protein"],), ([],)], "l array<string>").select(neighbourhood.kind_of(F.col("l")).alias("k")).collect()[0].k == "protein"


def test_further_sources(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<S><PubmedArticle><MedlineCitation><PMID Version='1'>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID>8</PMID></MedlineCitation></PubmedArticle></S>")
    assert rows(files.publications(spark, f"{tmp_path}/p.xml"))[1] == ("8", "", "")
    case = {"entities": [{"surface": "TP53", "id": "P", "kind": "gene", "canonical": "TP53"}], "cases": [{"pmid": "1", "text": "x", "gold": [{"edge_type": "R", "subject_id": "P", "object_id": "D", "polarity": "affirm"}]}, {"pmid": "2", "text": "y", "gold": []}]}
    (tmp_path / "l.json").write_text(json.dumps(case, indent=1))
    entities, gold = files.labelled(spark, f"{tmp_path}/l.json")
    assert entities.count() == 1 and rows(gold.select("pmid", "edge_type")) == [("1", "R"), ("2", None)]
    table = b"GENE_SYMBOL\tTIER\nA\t1\nB\t\n"
    with tarfile.open(tmp_path / "c_v2.tar", "w") as t:
        info = tarfile.TarInfo("inner.tsv")
        info.size = len(table)
        t.addfile(info, io.BytesIO(table))
    (tmp_path / "c_v1.tsv").write_bytes(b"GENE_SYMBOL\tTIER\nold\t1\n")
    (tmp_path / "d_v1.tsv").write_bytes(b"<!DOCTYPE html>\n")
    assert rows(omics.cancer_genes(files.delimited(spark, f"{tmp_path}/c_v*", ["GENE_SYMBOL", "TIER"]))) == [("A", "1", True), ("B", "1", True)]
    with pytest.raises(ValueError):
        files.delimited(spark, f"{tmp_path}/d_v*", ["GENE_SYMBOL"])


def test_protein_chain_and_weights(spark):
    cds = spark.createDataFrame([(0, {"protein_id": "ENSP1.2", "transcript_id": "T9.1"}), (1, {"protein_id": "ENSP1.2", "transcript_id": "T1.1"}), (2, {"protein_id": "9606.ENSP2", "transcript_id": "T2"}), (3, {"protein_id": "ENSP1", "transcript_id": "T2"})], "idx int, attributes map<string,string>")
    swiss = spark.createDataFrame([("T1.4", "U1"), ("T2", "U2")], "enst string, uniprot string")
    ensp = omics.ensp_to_uniprot(cds, swiss)
    assert rows(ensp.select("ensp", "uniprot")) == [("ENSP1", "U1"), ("ENSP2", "U2")]
    pairs = spark.createDataFrame([("9606.ENSP1", "9606.ENSP2", "980", "1", "2"), ("9606.ENSP2", "9606.ENSP1", "990", "5", "2"), ("9606.ENSP1", "9606.ENSP7", "999", "1", "2"), ("9606.ENSP1", "9606.ENSP2", "100", "1", "2")], "protein1 string, protein2 string, combined_score string, experimental string, coexpression string")
    assert rows(omics.interactions(pairs, ensp)) == [("INTERACTS_WITH", "U1", "U2", 0.99, 0.005, 0.002)] and tuple(omics.unmapped(pairs, ensp).first()) == (0, 1, 1)
    produces = spark.createDataFrame([("PRODUCES", "G1", "T1"), ("PRODUCES", "G1", "T2"), ("PRODUCES", "G2", "T3")], "rel string, src string, dst string")
    weights = spark.createDataFrame([("G1", 0.5)], "ensembl_id string, tw_Liver double")
    assert rows(omics.weighted(produces, weights).select("dst", "tw_Liver")) == [("T1", 0.5), ("T2", 0.5), ("T3", None)]


def test_regulations_associations_and_records(spark):
    protein = spark.createDataFrame([("U1", "TF1")], "uniprot_id string, hgnc_symbol string")
    gene = spark.createDataFrame([("G1", "A", "7"), ("G2", "B", "8"), ("G3", "C", "7")], "ensembl_id string, hgnc_symbol string, entrez string")
    tf = spark.createDataFrame([("TF1", "A", "A", "1.0"), ("TF1", "B", "B", "-1"), ("TF1", "C", "D", "1"), ("X", "A", "A", "1"), ("TF1", None, "A", "1")], "tf string, target string, confidence string, mor string")
    assert rows(omics.regulations(tf, protein, gene)) == [("REGULATES", "U1", "G1", "activator", 1.0, "A"), ("REGULATES", "U1", "G2", "repressor", 0.85, "B")]
    assert rows(omics.unmapped_symbols(tf, protein).select("hgnc_symbol")) == [("X",)]
    gwas = spark.createDataFrame([(0, "rs1", "1e-9", "1", "5", "A, B", "height", "u/EFO_1", "11"), (1, "rs1", "1e-10", "1", "5", "A", "height", "u/EFO_1", "12"), (2, "rs2", "1e-3", "1", "5", "A", "height", "u/EFO_1", "13"), (3, "x", "1e-9", None, None, "A", "t", "u/EFO_2", "14")], "idx int, SNPS string, `P-VALUE` string, CHR_ID string, CHR_POS string, MAPPED_GENE string, MAPPED_TRAIT string, MAPPED_TRAIT_URI string, PUBMEDID string")
    out = omics.associations(gwas, gene)
    assert rows(out["associated_with"]) == [("ASSOCIATED_WITH", "rs1", "EFO_1", 1e-10, ["12"])] and rows(out["in_gene"]) == [("IN_GENE", "rs1", "G1"), ("IN_GENE", "rs1", "G2")]
    assert rows(out["implicated_in"]) == [("IMPLICATED_IN", "G1", "EFO_1"), ("IMPLICATED_IN", "G2", "EFO_1")] and rows(out["diseases"]) == [("EFO_1", "height")]
    clin = spark.createDataFrame([(0, "1", "Benign", "GRCh37"), (1, "1", "Pathogenic", "GRCh38"), (2, "1", "Other", "GRCh38"), (3, "-1", "x", "GRCh38")], "idx int, `RS# (dbSNP)` string, ClinicalSignificance string, Assembly string")
    assert rows(omics.clinical_significance(clin, out["variants"])) == [("rs1", "Pathogenic")]
    said = spark.createDataFrame([(0, "7", "old"), (1, "7", "new"), (2, "8", " ")], "idx int, entrez string, summary string")
    assert rows(omics.gene_summaries(said, gene)) == [("G1", "new"), ("G3", "new")]
    hmdb = spark.createDataFrame([(0, "HMDB0000009", ["HMDB00005"], "second", "C1", "K1"), (1, "HMDB0000005", None, "own", "C2", "K2")], "idx int, accession string, secondary array<string>, name string, chemical_formula string, inchikey string")
    assert rows(omics.metabolite_records(hmdb, spark.createDataFrame([("HMDB0000005",)], "hmdb_id string"))) == [("HMDB0000005", "own", "C2", "K2")]
    hgnc = spark.createDataFrame([(0, "G1.4", "7.0"), (1, "G3.1", "7.0"), (2, "G9", " ")], "idx int, ensembl_gene_id string, entrez_id string")
    there, back = omics.entrez_maps(hgnc)
    assert rows(there) == [("G1", "7"), ("G3", "7")] and rows(back) == [("7", "G3.1")]
    loc = spark.createDataFrame([("U1", "nucleus:0.8|cytosol:0.9", "U2", "N/A:1.0|membrane:0.5"), ("U2", "nucleus:0.1", "U1", "nucleus:0.85")], "`Interactor A` string, `Major Loc A With Loc Score` string, `Interactor B` string, `Major Loc B With Loc Score` string")
    assert {r.uniprot_id: r.subcellular_locs for r in omics.locations(loc).collect()} == {"U1": ["cytosol", "nucleus"], "U2": ["membrane", "nucleus"]}


def test_moved_edges_take_few_bytes(spark, tmp_path):
    """Many new nodes of one old node: rows of the result are many, what they take where they are stored isn't."""
    cross = spark.range(4000).selectExpr("-(id % 10) - 1 as old", "id * 37 as new")
    e = spark.range(4000).selectExpr("'R' as rel", "-(xxhash64(id) % 10 + 10) % 10 - 1 as src", "id as dst").unionByName(spark.createDataFrame([("T", -1, 5), ("R", None, 6)], "rel string, src long, dst long"))
    got = upsert.reroot(e, cross, "R")
    got.write.parquet(f"{tmp_path}/moved")
    back = spark.read.parquet(f"{tmp_path}/moved")
    assert back.count() == 4000 * 400 + 1 and back.filter("rel = 'T'").count() == 1 and back.distinct().count() == back.count()
    assert sum(f.stat().st_size for f in (tmp_path / "moved").glob("*.parquet")) < 0.4 * 4000 * 400


def test_edges_of_a_node_are_moved_in_blocks(spark, tmp_path):
    """A node with very many new nodes: its rows lie in several tasks and take few bytes."""
    cross, e = spark.range(20000).selectExpr("-1L as old", "id * 37 as new"), spark.range(200).selectExpr("'R' as rel", "-1L as src", "id as dst")
    upsert.reroot(e, cross, "R").write.parquet(f"{tmp_path}/moved")
    back = spark.read.parquet(f"{tmp_path}/moved")
    assert back.count() == 4_000_000 and back.distinct().count() == 4_000_000
    assert back.select(F.input_file_name()).distinct().count() > 1
    assert sum(f.stat().st_size for f in (tmp_path / "moved").glob("*.parquet")) < 0.4 * 4_000_000


def test_blocks_and_runs_keep_every_moved_edge(spark):
    """Blocks and runs of all sizes, repeated rows, null ends, maps and nodes that one side lacks: as a plain join."""
    e = spark.range(60).selectExpr("if(id % 5 = 0, 'T', 'R') as rel", "if(id % 7 = 0, null, id % 4) as src", "map('k', id) as m", "if(id % 11 = 0, null, id div 2) as dst")
    e = e.unionByName(e.filter("dst < 5"))
    cross = spark.range(40).selectExpr("if(id % 9 = 0, null, id % 5) as old", "if(id % 8 = 0, null, concat('n', id div 3)) as new")
    e = e.withColumn("src", F.col("src").cast("string"))
    cross = cross.withColumn("old", F.col("old").cast("string"))
    plain = e.filter("rel = 'R'").join(cross, F.col("src") == F.col("old")).select("rel", F.col("new").alias("src"), "m", "dst").unionByName(e.filter("rel <> 'R'"))
    want = sorted(map(repr, plain.collect()))
    for block, run in (((1, 1), (1, 1)), ((3, 2), (2, 3)), ((1000, 3), (7, 1)), ((4, 1000), (1, 100))):
        got = upsert.reroot(e, cross, "R", block=block, run=run)
        assert got.columns == e.columns and sorted(map(repr, got.collect())) == want
    assert sorted(map(repr, upsert.reroot(e, cross.limit(0), "R").collect())) == sorted(map(repr, e.filter("rel <> 'R'").collect()))
