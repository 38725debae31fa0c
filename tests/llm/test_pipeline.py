"""The pipeline's stages on a small corpus, each held against what it decides on."""

import random

import corpus_pipeline as p
from weft.llm import quality


def test_stages(spark, tmp_path):
    good = lambda i: " ".join(f"word{(i * 37 + k * (i % 11 + 1)) % 997} and" for k in range(80))
    rows = [(i, good(i), "en", f"s{i % 4}", 0) for i in range(200)]
    rows += [(1000 + i, good(i), "en", "s0", 0) for i in range(20)] + [(2000 + i, "CLICK!! " * 90, "en", "s1", 0) for i in range(80)]
    rows += [(3000, good(500) + " mail me at joe@example.org now", "en", None, 0), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 2000), 0) for r in rows if r[0] is not None and r[0] < 2080], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert not [i for i in kept["quality"] if i is not None and 2000 <= i < 3000] and len(kept["quality"]) > 200
    assert not [i for i in kept["near_duplicates"] if i is not None and 1000 <= i < 1020]
    assert kept["personal_data"].keys() == kept["near_duplicates"].keys()
    assert "<email>" in kept["personal_data"][3000].text and "joe@" not in kept["personal_data"][3000].text
    pieces = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} <= kept["source_mix"].keys()
    assert quality.FEATURES


def test_mix_takes_the_drawn_blocks(spark):
    rows = [(i, " ".join(f"{i}_{k}" for k in range(300)), "en", "ab"[i % 2], 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r for r in p.mixing.drawn(docs).collect()}
    parts = {}
    for r in p.mix_sources(spark, docs, "").collect():
        places = [int(w.split("_")[1]) for w in r.text.split()]
        if len(places) < 300:
            assert r.doc_id not in parts and r.n_chars == len(r.text)
            parts[r.doc_id] = places
    for i, r in taken.items():
        assert parts.get(i, []) == [k for x in r.ranges or [] for k in range(x.first, x.end)][: 300 if r.taken % 300 else 0]
        assert len(parts.get(i, [])) == r.taken % 300
    assert any(x[-1] == 299 for x in parts.values()) and any(x[0] > 0 for x in parts.values())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k1 int, spans string, size int, taken string"
EXTRA = (1, "x", 2, "y")


def test_repeated_rows(spark, tmp_path):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(1, text(1), "en", "a", 0, *EXTRA)] * 4 + [(1, text(2), "en", "a", 0, *EXTRA)] + [(None, text(3), "en", "a", 0, *EXTRA)] * 3 + [(2, text(1), "en", "a", 0, *EXTRA), (3, None, None, None, None, *EXTRA)] + [(4, text(4), "de", "a", 0, *EXTRA), (4, text(4), "en", "a", 0, *EXTRA)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = p.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.lang or "") for r in kept.collect()) == sorted([(1, text(1), "en"), (1, text(2), "en"), (0, text(3), "en"), (3, "", ""), (4, text(4), "de")])
    assert p.mask_personal_data(spark, docs, "").count() == len(rows)


def test_mix_of_repeated_ids(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        n = rng.choice([10, 40, 200])
        rows.append((rng.choice([None, 7, i]), " ".join(f"w{i}_{k}" for k in range(n)), "en", rng.choice(["a", "b", None]), 0, *EXTRA))
    rows += rows[:5] * 2
    docs = spark.createDataFrame(rows, COLUMNS)
    want, got = {}, {}
    for r in p.mixing.drawn(docs).collect():
        want[(r.doc_id, r.k1)] = want.get((r.doc_id, r.k1), 0) + r.taken
    out = p.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    for r in out.collect():
        first = r.text.split()[0].split("_")[0]
        got[first] = got.get(first, 0) + len(r.text.split())
    keys = {r.k1: r.text.split()[0].split("_")[0] for r in docs.select("text", p.row_key(p.F.col("doc_id"), p.F.col("text"))[0].alias("k1")).collect()}
    assert got == {keys[k]: n for (_, k), n in want.items() if n}


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in p.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
