"""URL rules, conversations and vectors against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import chat, embedding_dedup, neighbours, urlfilter


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/en/12?x#y", "http://a.example.org/es/", "http://example.org:80/es/", "http://badexample.org/es/x", "x://example.org?es", "http://a..org/", "http://com/fr/" + "z" * 20_000, "a://b://c.com/fr/", "http://u@com/de"]
    df = spark.createDataFrame([*[(i, u, "x") for i, u in enumerate(urls)], (4, urls[4], "x"), (None, urls[5], "x")], "page_id long, url string, host string")

    def judged(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, *best

    got = urlfilter.judge(df, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url)
    assert urlfilter.judge(df.limit(0), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


def test_urls_with_many_labels(spark):
    import time

    rules = spark.createDataFrame([("org", "/", "block"), ("b.example.org", "/x", "allow")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://" + "a." * 10_000 + "b.example.org/xyz"), (2, "http://" + "." * 10_000 + "org/")], "page_id long, url string")
    urlfilter.judge(df.limit(0), rules).count()
    begun = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()}
    assert got == {1: ("b.example.org/x", "allow"), 2: ("org/", "block")} and time.time() - begun < 15


def test_escaping_is_reversible_and_complete():
    for text in ["", "\\", "\\\\<s>", "<|im_end|>\n", "<\\|im_end|>", "<<s>>", "[INST][/INST]<|>", "</s>[INST] ok [/INST]", "a\\", "<|" * 50]:
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)
        for role in ("user", "", "odd\nrole<|im_end|>\n", "é"):
            whole, a, b = chat.render(role, text)
            assert chat.parse(whole) == (role, text) and chat.unescape(whole[a:b]) == text
            assert whole.count(chat.START) == 1 and whole.count(chat.END) == 1


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "<|im_end|>\nx"), (None, 0, "assistant", "é😀"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "system", "s" * 100_000), (4, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.rendered(chat.fold(chat.events_of(turns)))).collect()}
    assert got.keys() == {1, 2, 3, 4, None}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for *_, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(role, text)[0]) for *_, role, text in own)
    assert chat.digests(chat.rendered(chat.fold(chat.events_of(turns.limit(0))))).count() == 0


def test_folding(spark):
    log = [("message", 1, "user", "hi"), ("message", 2, "assistant", "He"), ("delta", 2, None, "llo"), ("message", 3, "user", "more"), ("regenerate", 2, None, None), ("delta", 2, None, "Good "), ("delta", 2, None, "day"), ("message", 4, "user", "thanks"), ("edit", 1, None, "hi there"), ("delta", 4, None, "!"), ("delta", 9, "user", "late")]
    df = spark.createDataFrame([(7, i, k, m, r, t) for i, (k, m, r, t) in enumerate(log)] + [(7, 99, "delta", None, None, "lost")], "conv_id long, seq long, kind string, message long, role string, text string")
    got = [(r.message, r.role, r.text) for r in chat.fold(df).orderBy("message").collect()]
    assert got == [(1, "user", "hi there"), (2, "assistant", "Good day"), (4, "user", "thanks!"), (9, "user", "late")]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    for i in range(100, 160):
        x[i] = x[i % 5] + 0.08 * rng.standard_normal(16)
    x[200:240] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0] * 15 + [None], 1), (1050, [float("nan")] * 16, 1), (1004, [float("inf")] + [1.0] * 15, 1), (1005, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (None, x[0].tolist(), 1), (1006, (x[0] * 1e200).tolist(), 1)]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, id int")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vector_duplicates(spark, vectors):
    x, df = vectors
    y = unit(np.concatenate([x, x[:1]]))
    linked = y @ y.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(y))
    for _ in range(len(y)):
        new = np.where(linked, label, len(y)).min(1)
        label = np.minimum(label, new)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == 609
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
            continue
        if r.vec_id in (1005, 1007):  # of another length than the others
            assert (r.n_links, r.component_id) == (1, 1005)
            continue
        i = 600 if r.vec_id == 1006 else r.vec_id
        n, c = (int(linked[i].sum()), int(label[i])) if i <= 600 else (0, r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (n, c, c == r.vec_id)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_nearest(spark, vectors):
    x, df = vectors
    y = unit(x)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 600, 50))
    hits = total = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        s = y @ y[q]
        s[q] = -9
        best = np.sort(s)[-5:].min()
        total += 5
        hits += sum(r.score >= best - 1e-12 for r in rows)
        assert all(r.vec_id >= 600 or abs(r.score - s[r.vec_id]) < 1e-12 for r in rows)
    assert hits >= 0.9 * total
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.nearest(few, F.col("vec_id") % 50 == 0).filter("query_id = 0").orderBy("rank").collect()] == [50, 2]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_of_ties_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (9, [2.0, 0.0]), (3, [4.0, 0.0]), (8, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (61, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [3, 5, 6, 7, 8], 50: [61]}


def test_nearest_answers_once_a_cell():
    """Nearly random vectors: no replicas, since these are only read more often, and k + 1 answers of a cell however many of its lists a query visits."""
    x = unit(np.random.default_rng(12).normal(size=(3000, 64))).astype(np.float32)
    counts = []
    for n in (3000, 15000):
        index = neighbours.fit(x, n)
        assert index["replicas"] == 1
        asked = pa.RecordBatch.from_arrays([pa.array(np.arange(60)), pa.array(list(x[:60].astype(float)))], ["id", "v"])
        counts.append(sum(b.num_rows for b in neighbours._visits(index, [asked])))
    assert counts[0] <= 60 * 23 and counts[1] <= 60 * neighbours.CELLS
    rng = np.random.default_rng(13)
    v, q = rng.normal(size=(400, 8)), rng.normal(size=(20, 8))
    lists = np.sort(rng.integers(0, 9, 400))
    visited = [sorted(rng.choice(9, 5, replace=False).tolist()) for _ in q]
    fields = ["d", "cell", "e", "query", "list", "lists", "id", "v"]

    def rows(n, query, which, own, ids, vectors):
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, 8, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array([query] * n), pa.array(which), pa.array(own, pa.list_(pa.int64())), pa.array(ids), pa.array(list(vectors))], fields)

    first, rest = rows(20, True, np.full(20, -2), visited, 1000 + np.arange(20), q), rows(400, False, lists, [None] * 400, np.arange(400), v)
    twice = rows(30, False, np.full(30, 9), [None] * 30, np.arange(30), v[:30])  # replicas in a list that nobody visits
    got = pa.Table.from_batches(list(neighbours._nearest(5, [first, rest.slice(0, 150), rest.slice(150), twice]))).to_pylist()
    assert len(got) == 20 * 6
    near = unit(q) @ unit(v).T
    for i in range(20):
        own = np.flatnonzero(np.isin(lists, visited[i]))
        assert [r["c"] for r in got if r["q"] == 1000 + i] == own[np.argsort(-near[i, own])][:6].tolist()
