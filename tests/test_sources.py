"""Line numbers over splits, archive members as partitions, records in batches."""

import gzip
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from weft.plans import omics
from weft.sources import archives, files, lines, records


@pytest.fixture
def small_splits(spark):
    """Sets how many bytes a split has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, small_splits):
    for k, n in enumerate((700, 1, 300)):
        (tmp_path / f"f{k}.txt").write_text("".join(f"{k}:{i}" + "x" * (i % 37) + "\n" for i in range(n)))
    expected = [f"{k}:{i}" + "x" * (i % 37) for k, n in enumerate((700, 1, 300)) for i in range(n)]
    for size in (64, 1000, 1 << 20):
        small_splits(size)
        got = lines.numbered(spark.read.text(str(tmp_path)))
        assert size > 64 or got.rdd.getNumPartitions() > 8
        assert [r.value for r in got.orderBy("idx").collect()] == expected and got.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first() == (0, 1000, 1001)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.txt").write_text("")
    assert lines.numbered(spark.read.text(str(tmp_path / "none"))).count() == 0


def test_the_last_line_wins(spark, tmp_path, small_splits):
    head = "symbol\tensembl_gene_id\tuniprot_ids\n"
    (tmp_path / "h.tsv").write_text(head + "".join(f"S{i % 50}\tENSG{i:011d}.1\tU{i}\n" for i in range(400)))
    for size in (100, 1 << 20):
        small_splits(size)
        got = files.tsv(spark, str(tmp_path / "h.tsv"), ["symbol", "ensembl_gene_id"], idx=True)
        assert got.columns == ["symbol", "ensembl_gene_id", "idx"]
        last = got.groupBy("symbol").agg(F.max_by("ensembl_gene_id", "idx").alias("e"), F.min_by("ensembl_gene_id", "idx").alias("f"))
        assert {r.symbol: (r.e, r.f) for r in last.collect()} == {f"S{k}": (f"ENSG{350 + k:011d}.1", f"ENSG{k:011d}.1") for k in range(50)}


def test_gtf_and_gct_lines(spark, tmp_path, small_splits):
    good = 'chr1\tx\ttranscript\t{0}\t9\t.\t+\t.\tgene_id "G{0}"; transcript_id "T{0}";'
    text = ["# made", "", "chr1\tshort", good.format(1), good.format("oops"), good.format(2).replace("transcript\t", "exon\t", 1), good.format(3), good.format(4) + "\tmore"]
    (tmp_path / "a.gtf").write_text("\n".join(text) + "\n")
    (tmp_path / "a.gct").write_text("#1.2\n2\t2\nName\tDescription\tLiver\tBrain\n" + "".join(f"G{i % 3}.1\td\t{i}\t\n" for i in range(9)))
    for size in (40, 1 << 20):
        small_splits(size)
        assert sorted((r.start, r.attributes["gene_id"], r.idx) for r in files.gtf(spark, str(tmp_path / "a.gtf"), idx=True).collect()) == [(1, "G1", 3), (3, "G3", 6)]
        g = files.gct(spark, str(tmp_path / "a.gct"), ["Liver", "Brain"], idx=True)
        assert sorted((r.Name, r.Liver, r.Brain, r.idx) for r in g.collect()) == sorted((f"G{i % 3}.1", float(i), None, 3 + i) for i in range(9))
    assert "idx" not in files.gtf(spark, str(tmp_path / "a.gtf")).columns


def test_archive_members_are_tasks(spark, tmp_path):
    def body(k, n, sep="\t"):
        return (sep.join(["B", "A", "C"]) + "\n" + "".join(sep.join([f"b{k}", f"a{i}", "" if i % 2 else "NA" if i % 5 == 0 else f"c{i}"]) + "\n" for i in range(n))).encode()

    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(8):
            z.writestr(f"m{k}.tsv", body(k, 10 * k + 1))
        z.writestr("readme.md", "no table")
    got = archives.table(spark, f"{tmp_path}/x.zip", ["A", "B"], origin=True)
    assert got.rdd.getNumPartitions() == 8
    assert {r.member: r.n for r in got.groupBy("member").agg(F.count(F.lit(1)).alias("n")).collect()} == {f"m{k}.tsv": 10 * k + 1 for k in range(8)}
    assert [(r.A, r.B, r.row) for r in got.filter("member = 'm1.tsv'").orderBy("row").collect()] == [(f"a{i}", "b1", i) for i in range(11)]
    for name, mode in (("y.tar", "w"), ("y.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for k, (inner, data) in enumerate([("d/p.csv", body(1, 5, ",")), ("q.tsv.gz", gzip.compress(body(2, 3))), ("r.txt", body(3, 2)), ("s.bin", b"\0" * 1000)]):
                info = tarfile.TarInfo(inner)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        own = archives.table(spark, f"{tmp_path}/{name}", ["C", "B"])
        assert own.columns == ["C", "B"] and own.rdd.getNumPartitions() == (3 if mode == "w" else 1)
        assert sorted((r.C or "", r.B) for r in own.collect()) == sorted([("", "b1"), ("", "b1"), ("", "b1"), ("c2", "b1"), ("c4", "b1"), ("", "b2"), ("", "b2"), ("c2", "b2"), ("", "b3"), ("", "b3")])
    (tmp_path / "page.zip").write_text("<!DOCTYPE html>")
    with pytest.raises(Exception, match="web page"):
        files.zipped_tsv(spark, f"{tmp_path}/page.zip", ["A"]).count()
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("readme.md", "no table")
    assert files.zipped_tsv(spark, f"{tmp_path}/empty.zip", ["A"]).count() == 0


def test_a_member_larger_than_its_chunks(spark, tmp_path):
    n = 3 * archives.CHUNK_ROWS + 7
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.tsv", "w") as f:
        f.write(b"A\tB\n")
        for i in range(n):
            f.write(b"%d\t%d\n" % (i, i % 3))
    (only,) = archives.members(f"{tmp_path}/big.zip")
    sizes = [b.num_rows for b in archives._Reader({"paths": "[]", "columns": '["A"]'}).read(only)]
    assert sizes == [archives.CHUNK_ROWS] * 3 + [7]
    assert files.zipped_tsv(spark, f"{tmp_path}/big.zip", ["A"]).agg(F.sum(F.col("A").cast("long"))).first()[0] == n * (n - 1) // 2


def service(folder, fail_first=0, broken=()):
    """A fetch that notes what it is asked, is busy `fail_first` times in a batch, never answers for batches with `broken` ids, and knows no id that ends in 7."""

    def fetch(ids):
        name = os.path.join(folder, ids[0])
        turn = len(open(name).read()) if os.path.exists(name) else 0
        with open(name, "a") as f:
            f.write("x")
        with open(os.path.join(folder, "asked"), "a") as f:
            f.write(" ".join(ids) + "\n")
        if turn < fail_first:
            raise records.Busy(0.01)
        if any(i in broken for i in ids):
            raise OSError("no answer")
        return {i: {"name": f"n{i}", "frequency": float(i)} for i in ids if not i.endswith("7")}

    return fetch


def test_records_in_batches_with_retries(spark, tmp_path):
    ids = spark.createDataFrame([(str(i % 40),) for i in range(80)] + [(None,)], "rsid string")
    got = records.fetched(ids, service(str(tmp_path), fail_first=2), "name string, frequency double", size=7, tasks=3, pause=0.01).collect()
    assert sorted((int(r.id), r.name, r.status, r.error) for r in got) == [(i, None if i % 10 == 7 else f"n{i}", "absent" if i % 10 == 7 else "found", None) for i in range(40)]
    asked = [line.split() for line in open(tmp_path / "asked").read().splitlines()]
    assert max(map(len, asked)) <= 7 and len(asked) == 3 * len({tuple(a) for a in asked})
    waits = []
    assert records.asked(lambda ids: 1 / 0, ["1"], 3, 2.0, waits.append) == ({}, "ZeroDivisionError: division by zero") and waits == [2.0, 4.0]

    def busy(ids):
        raise records.Busy(9.0)

    waits.clear()
    assert records.asked(busy, ["1"], 2, 2.0, waits.append)[1] == "busy for 9.0 s" and waits == [9.0]


def test_records_resume(spark, tmp_path):
    os.mkdir(tmp_path / "a")
    os.mkdir(tmp_path / "b")
    ids = spark.createDataFrame([(str(i), i % 3 == 0) for i in range(30)], "rsid string, wanted boolean")
    order, options = [F.col("wanted").desc()], {"size": 5, "tasks": 1, "tries": 2, "pause": 0.01, "portion": 10}
    counts = records.land(ids, service(str(tmp_path / "a"), broken=("3", "4")), "name string, frequency double", f"{tmp_path}/out", order, **options)
    assert sum(counts.values()) == 30 and counts["failed"] >= 2
    first = {i for line in open(tmp_path / "a" / "asked").read().splitlines()[:2] for i in line.split()}
    assert all(int(i) % 3 == 0 for i in first)
    failed = {str(i) for i in range(30)} - {r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(failed) == counts["failed"] and {"3", "4"} <= failed
    again = records.land(ids, service(str(tmp_path / "b")), "name string, frequency double", f"{tmp_path}/out", order, **options)
    assert sum(again.values()) == counts["failed"] and again["failed"] == 0
    assert {i for line in open(tmp_path / "b" / "asked").read().splitlines() for i in line.split()} == failed
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 30 == out.select("id").distinct().count() and out.filter("status = 'absent'").count() == 3
    assert sum(records.land(ids, service(str(tmp_path / "b")), "name string, frequency double", f"{tmp_path}/out").values()) == 0


def test_line_numbers_reach_the_builders(spark, tmp_path, small_splits):
    (tmp_path / "h.tsv").write_text("ensembl_gene_id\tentrez_id\n" + "".join(f"ENSG{i}.1\t{i % 7}.0\n" for i in range(200)) + "".join(f"ENSG{i}.1\t{100 + i}\n" for i in range(5)))
    for size in (50, 1 << 20):
        small_splits(size)
        to, back = omics.entrez_maps(files.tsv(spark, str(tmp_path / "h.tsv"), ["ensembl_gene_id", "entrez_id"], idx=True))
        assert {r.ensembl_id: r.entrez for r in to.filter("length(ensembl_id) = 5").collect()} == {f"ENSG{i}": str(100 + i) if i < 5 else str(i % 7) for i in range(10)}
        assert {r.entrez: r.ensembl_id for r in back.filter("entrez < 7").collect()} == {str(k): f"ENSG{max(i for i in range(200) if i % 7 == k)}.1" for k in range(7)}
