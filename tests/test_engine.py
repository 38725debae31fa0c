"""Upserts, normalisers, literature, readers, the step runner and streaming."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from weft.functions import normalize as N
from weft.operators import literature as L
from weft.operators import search, upsert
from weft.plans import omics, pipeline
from weft.sources import files
from weft.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "kept"), (None, "n", "z")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "lost"), (3, "c", "w"), (1, None, "filled")], "k int, v string, w string")
    once = upsert.merge(old, new, ["k"], keep_old=("w",))
    assert sorted(once.collect(), key=str) == sorted(upsert.merge(once, new, ["k"], keep_old=("w",)).collect(), key=str)
    assert {r.k: (r.v, r.w) for r in once.collect()} == {1: ("a", "filled"), 2: ("B", "kept"), 3: ("c", "w"), None: ("n", "z")}
    same, unmatched = upsert.enrich(old, new, ["k"])
    assert same.count() == 3 and [r.k for r in unmatched.collect()] == [3]


def test_sentences_and_traits(spark):
    assert one(spark, N.sentences(F.lit("Cells die, e.g. Neurons. 5-HT binds! what? Yes."))) == ["Cells die, e.g. Neurons.", "5-HT binds! what?", "Yes."]
    assert one(spark, N.sentences(F.lit(""))) == []
    got = one(spark, N.traits(F.lit("1,4-dihydro measurement, 7, "), F.lit("http://x/EFO_1, http://x/EFO_2, http://x/EFO_3/, , nan")))
    assert [(t.id, t.name) for t in got] == [("EFO_1", "1,4-dihydro measurement"), ("EFO_2", "EFO_2"), ("EFO_3", "EFO_3")]
    assert one(spark, N.verdict(F.lit('x {"polarity": "HEDGE", "confidence": -3} y'))).confidence == 0
    assert one(spark, N.verdict(F.lit("none"))) is None
    for a, n, c in ((0, 2, 0.0), (1, 0, 0.5), (2, 0, 0.75), (3, 0, 0.875), (2, 1, 0.5)):
        assert one(spark, N.evidence_confidence(F.lit(a), F.lit(n))) == c


def test_longest_match_and_gates(spark):
    entities = spark.createDataFrame([("g1", "gene", "EGFR", ["ERBB1"]), ("g2", "gene", "MAX", None), ("d1", "disease", "breast cancer", None), ("d2", "disease", "cancer", None), ("d3", "disease", "7", None)], "node_id string, kind string, name string, aliases array<string>")
    docs = spark.createDataFrame([(1, "EGFR drives Breast Cancer. egfr and max 7 cancer. ERBB1 too, MAX."), (2, None)], "doc_id long, text string")
    got = {(r.sentence_no, r.start, r.node_id) for r in L.link(L.sentences(docs), L.gazetteer(entities)).collect()}
    assert got == {(0, 0, "g1"), (0, 2, "d1"), (1, 0, "g1"), (1, 2, "g2")}
    pairs = L.pairs(L.link(L.sentences(docs), L.gazetteer(entities))).collect()
    assert [(p.subject_id, p.rel, p.object_id) for p in pairs] == [("g1", "IMPLICATED_IN", "d1")]


def test_promotion_and_exact_revert(spark):
    edges = spark.createDataFrame([("a__R__b", "R", "a", "b", ["A", "B"], None)], "triple_key string, rel_type string, subject_id string, object_id string, pmids array<string>, tier string")
    chosen = spark.createDataFrame([("a__R__b", "R", "a", "b"), ("c__R__d", "R", "c", "d")], "triple_key string, rel_type string, subject_id string, object_id string")
    evidence = spark.createDataFrame([("a__R__b", "B", "affirm"), ("a__R__b", "C", "affirm"), ("a__R__b", "D", "negate"), ("c__R__d", "E", "affirm")], "triple_key string, pmid string, polarity string")
    out, log = L.promote(edges, chosen, evidence)
    assert {r.triple_key: (r.pmids, r.tier) for r in out.collect()} == {"a__R__b": (["A", "B", "C"], None), "c__R__d": (["E"], "literature")}
    assert {r.triple_key: (r.promotion_kind, r.enriched_pmids) for r in log.collect()} == {"a__R__b": ("enrich", ["C"]), "c__R__d": ("mint", ["E"])}
    assert [tuple(r) for r in L.revert(out, log).collect()] == [("a__R__b", "R", "a", "b", ["A", "B"], None)]


def test_repeated_and_null_keys(spark):
    table = lambda rows: spark.createDataFrame(rows, "k string, v int, l array<string>")
    old, new = table([("a", 1, None), (None, 2, ["x"])]), table([("b", 9, ["y"]), ("b", 3, None), ("b", 9, ["y"]), (None, 7, None), ("a", 8, None), ("c", 1, None)])
    got = upsert.insert_only(old, new, ["k"])
    assert sorted((r.k or "", r.v) for r in got.collect()) == [("", 2), ("a", 1), ("b", 3), ("c", 1)]
    assert {r.k: r.v for r in upsert.insert_only(old, new, ["k"], [F.col("v").desc()]).collect()} == {"a": 1, None: 2, "b": 9, "c": 1}
    assert sorted(map(tuple, upsert.insert_only(got, new, ["k"]).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    updated, unmet = upsert.enrich(old, table([(None, 5, None), ("z", 6, None)]), ["k"])
    assert {r.k: r.v for r in updated.collect()} == {"a": 1, None: 5} and [r.k for r in unmet.collect()] == ["z"]


def test_read_only_sql(spark):
    spark.range(100).createOrReplaceTempView("weft_hundred")
    assert search.read_only_sql(spark, "select * from weft_hundred").count() == 30
    for bad in ("drop view weft_hundred", "select 1; drop view weft_hundred", "insert into weft_hundred select 1"):
        with pytest.raises(Exception):
            search.read_only_sql(spark, bad).count()


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.gtf.gz", "wt") as f:
        f.write('#x\nchr1\tH\ttranscript\t10\t20\t.\t+\t.\tgene_id "ENSG1.2"; transcript_id "ENST1.1"; tag "a"; tag "b";\nchr1\tH\texon\t1\t2\t.\t+\t.\tx "y";\n')
    r = files.gtf(spark, str(tmp_path / "a.gtf.gz")).first()
    assert (r.start, r.end, r.attributes["gene_id"], r.attributes["tag"]) == (10, 20, "ENSG1.2", "b")
    (tmp_path / "a.gct").write_text("#1.2\n2\t2\nName\tDescription\tLiver\tBrain\nG1\tx\t1.5\t2\nG2\ty\tbad\t3\n")
    assert [tuple(r) for r in files.gct(spark, str(tmp_path / "a.gct"), ["Brain", "Liver"]).collect()] == [("G1", 2.0, 1.5), ("G2", 3.0, None)]
    (tmp_path / "a.gmt").write_text("S1\tu\tA\tB\nS2\tu\nS3\tu\tC\n")
    assert [(r.set_name, r.gene) for r in files.gmt(spark, str(tmp_path / "a.gmt")).orderBy("line", "gene").collect()] == [("S1", "A"), ("S1", "B"), ("S3", "C")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.tsv", "A\tB\tC\n1\t2\t3\n4\t\t6\n")
    assert [tuple(r) for r in files.zipped_tsv(spark, str(tmp_path / "a.zip"), ["C", "B"]).collect()] == [("3", "2"), ("6", None)]
    (tmp_path / "a.xml").write_text("<r><m><accession>H1</accession></m><m><accession>H2</accession></m></r>")
    assert files.xml(spark, str(tmp_path / "a.xml"), "m", "accession string").count() == 2
    (tmp_path / "t.tsv").write_text("# note\nx\ty\n1\t2\n")
    assert files.tsv(spark, str(tmp_path / "t.tsv"), ["y"], comment="#").first().y == "2"
    with pytest.raises(ValueError):
        files.tsv(spark, str(tmp_path / "t.tsv"), ["z"], comment="#")


def test_omics_sources(spark):
    hgnc = spark.createDataFrame([(0, "TP53", "tumor protein", "HGNC:1", "ENSG1.3", "17p13.1", "p53|TP53", "", "P04637|X", "7157.0"), (1, "A", "a", "HGNC:2", None, "", "", "", "", "")], "idx int, symbol string, name string, hgnc_id string, ensembl_gene_id string, location string, alias_symbol string, prev_symbol string, uniprot_ids string, entrez_id string")
    gene = omics.genes(hgnc)
    assert [tuple(r)[:1] + (r.chromosome, r.aliases, r.entrez) for r in gene.collect()] == [("ENSG1", "17", ["p53"], "7157")]
    ids = omics.id_map(hgnc)
    tx = spark.createDataFrame([("ENST1",)], "ensembl_tx_id string")
    protein, edges = omics.proteins(ids, spark.createDataFrame([("ENST1.1", "P04637")], "enst string, uniprot string"), tx, gene)
    assert [tuple(r) for r in edges.collect()] == [("TRANSLATES_TO", "ENST1", "P04637")] and protein.count() == 1
    gwas = spark.createDataFrame([(0, "rs1", "1e-9", "1", "5", "TP53, Q", "height", "http://x/EFO_1", "11"), (1, "rs1", "1e-9", "1", "5", "TP53", "tallness", "http://x/EFO_1", "12"), (2, "rs2", "0.1", "1", "6", "TP53", "x", "y/z", "13")], "idx int, SNPS string, `P-VALUE` string, CHR_ID string, CHR_POS string, MAPPED_GENE string, MAPPED_TRAIT string, MAPPED_TRAIT_URI string, PUBMEDID string")
    g = omics.associations(gwas, gene)
    assert [(r.src, r.dst, r.score, r.pmids) for r in g["associated_with"].collect()] == [("rs1", "EFO_1", 1e-9, ["11"])]
    assert [(r.ontology_id, r.name) for r in g["diseases"].collect()] == [("EFO_1", "tallness")] and g["implicated_in"].count() == g["in_gene"].count() == 1
    loc = spark.createDataFrame([("P1", "nucleus:0.8|cytosol:0.9|N/A:1", "P2", "x:0.1"), ("P1", "nucleus:0.95", "P1", "bad")], "`Interactor A` string, `Major Loc A With Loc Score` string, `Interactor B` string, `Major Loc B With Loc Score` string")
    assert {r.uniprot_id: (r.subcellular_locs, r.subcellular_loc_scores) for r in omics.locations(loc).collect()} == {"P1": (["nucleus", "cytosol"], [0.95, 0.9]), "P2": (["x"], [0.1])}
    pli = spark.createDataFrame([(0, "G", "0.1", "false"), (1, "G", "0.2", "true"), (2, "G", "0.3", "TRUE"), (3, "H", "0.4", None), (4, "H", "0.5", None)], "idx int, gene string, `lof.pLI` string, mane_select string")
    assert {r.gene: r.pli_score for r in omics.constraint(pli).collect()} == {"G": 0.3, "H": 0.4}
    af = spark.createDataFrame([("rs1", "A", [("gnomADe:ALL", "G", 0.9), ("gnomADg:ALL", "G", 0.3), ("gnomADg:ALL", "T", 0.9)]), ("rs2", "A", [("x", "G", 0.1)])], "rsid string, reference string, populations array<struct<population string, allele string, frequency double>>")
    assert [tuple(r) for r in omics.frequencies(af).collect()] == [("rs1", 1.0)]


def test_steps(spark):
    def fails(s, t):
        raise RuntimeError("no")

    steps = [pipeline.Step("c", lambda s, t: {"c": t["a"]}, ("b",)), pipeline.Step("a", lambda s, t: {"a": s.range(3)}), pipeline.Step("b", fails, ("a",)), pipeline.Step("d", lambda s, t: {"d": t["a"]}, ("a",))]
    tables, log = pipeline.run(spark, steps, {})
    assert {r.step: r.status for r in log.collect()} == {"a": "ok", "b": "failed", "c": "skipped", "d": "ok"} and tables["d"].count() == 3
    with pytest.raises(ValueError):
        pipeline.ordered([pipeline.Step("x", fails, ("y",))])


def test_streams(spark, tmp_path):
    rows = [(i % 8, f"2024-01-01 00:{i:02}:00", i % 2, 1.0) for i in range(16)]
    df = spark.createDataFrame(rows, "event_id long, ts string, kind int, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = events.read(spark, f"{tmp_path}/in", df.schema)
    events.run_available(stream, lambda b, i: seen.append(events.last_write(b, ["event_id"], "ts").count()), f"{tmp_path}/c1")
    assert len(seen) == 2 and 8 <= sum(seen) <= 16
    events.run_available(stream, lambda b, i: seen.append(0), f"{tmp_path}/c1")
    assert 0 not in seen
    out = []
    events.run_available(events.tumbling(events.deduplicated(stream, "event_id", "ts", "1 hour"), "ts", None, "10 minutes", "kind"), lambda b, i: out.extend(b.collect()), f"{tmp_path}/c2", "append")
    assert sum(r.n for r in out) <= 16
