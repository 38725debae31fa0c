"""Dictionary matches by a trie and by joins, against a plain walk."""

import random
import time

import pytest

from weft.operators import dictionary, literature


def plain(sentence, surfaces):
    """Longest matches left to right, word by word."""
    words = dictionary.WORDS.findall(sentence)
    by_lower = {}
    for surface, node, kind, canonical in surfaces:
        by_lower.setdefault(surface.lower(), []).append((surface, node, kind, canonical))
    out, at = [], 0
    while at < len(words):
        for n in range(len(words) - at, 0, -1):
            found = " ".join(words[at : at + n])
            kept = {e[1:] for e in by_lower.get(found.lower(), []) if dictionary.passes(found, e[0])}
            if kept:
                out += [(at, n, found, *e) for e in kept]
                at += n
                break
        else:
            at += 1
    return sorted(out)


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_links(spark, monkeypatch, bound):
    monkeypatch.setattr(dictionary, "BROADCAST_BYTES", bound)
    rng = random.Random(9)
    vocabulary = ["TP53", "tp53", "type", "2", "diabetes", "MET", "met", "cancer", "breast", "HLA-A", "5-HT", "mellitus", "Alpha", "p53", "42", "é", "T"]
    names = ["type 2 diabetes", "diabetes", "diabetes mellitus", "TP53", "p53", "MET", "T", "cancer", "breast cancer", "HLA-A", "5-HT", "Alpha", "alpha", "42", "type 2", "odd  spaces", "end.", "é", "2 diabetes"]
    surfaces = [(n, f"N{i % 12}", "gene" if i % 2 else "disease", n.upper()) for i, n in enumerate(names)] + [("TP53", "N99", "protein", "TP53")]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(0, 25))) for _ in range(200)] + ["", "Type 2 Diabetes mellitus, HLA-A.", None, "breast Cancer cancer"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, sentence_no int, sentence string").repartition(5)
    entities = spark.createDataFrame([(node, kind, canonical, [surface]) for surface, node, kind, canonical in surfaces], "node_id string, kind string, name string, aliases array<string>")
    given = literature.gazetteer(entities)
    every = [(r.surface, r.node_id, r.kind, r.canonical) for r in given.collect()]
    got = {}
    for r in literature.link(rows, given).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n, r.found, r.node_id, r.kind, r.canonical))
    assert {i: sorted(v) for i, v in got.items()} == {i: p for i, t in enumerate(texts) if (p := plain(t or "", every))}
    assert literature.link(rows.limit(0), given).count() == 0 and literature.link(rows, given.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_many_matches_in_one_sentence(spark, monkeypatch, bound):
    monkeypatch.setattr(dictionary, "BROADCAST_BYTES", bound)
    given = literature.gazetteer(spark.createDataFrame([("G", "gene", "alphabet", None), ("H", "gene", "alphabet soup", None)], "node_id string, kind string, name string, aliases array<string>"))
    rows = spark.createDataFrame([(1, 0, "alphabet soup alphabet " * 100_000)], "doc_id long, sentence_no int, sentence string")
    literature.link(rows.limit(0), given).count()
    begun = time.time()
    got = literature.link(rows, given)
    assert {r.node_id: r["count"] for r in got.groupBy("node_id").count().collect()} == {"G": 100_000, "H": 100_000}
    assert time.time() - begun < 30
