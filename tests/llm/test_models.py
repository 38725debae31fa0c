"""Whitening, importance resampling and language-model scores against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import importance, lexicon, pitman_yor, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, word string, chunk string, n int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA)


# Whitening ---------------------------------------------------------------------------------------------------------


def whitened(rows, components=32):
    """Plain whitening of (id, vector) rows of one length: deviations, covariance, and the matrix of deviations from the mean."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    z = np.array(y, float) / n
    return [sum(c * c for c in v) for v in y], z.T @ z / n, z


def test_whitening(spark):
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=40) * np.linspace(1, 3, 40)).round(3).tolist()) for i in range(300)]
    good += [good[3], (None, good[4][1])]
    bad = [(500, None), (501, [1.0, None] * 20), (502, [float("nan")] * 40), (503, [float("inf")] * 40), (504, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<float>, id int, v int").repartition(7)
    got = whitening.whiten(df).toPandas()
    deviations, cov, z = whitened(good)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    expected = z @ vectors[:, :32] / np.sqrt(values[:32])
    assert len(got) == len(good) * 32 and set(got.n) == {len(good)} and got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values[:32] / values.sum(), rtol=1e-9)
    for k in range(32):
        own = got[got.component == k + 1]
        sign = None
        for i in (0, 7, 100, 299):
            a, b = own[own.vec_id == i].whitened.iloc[0], expected[i, k]
            sign = sign or np.sign(a * b)
            assert abs(a - sign * b) < 1e-7
    by_id = got[got.component == 1].set_index("vec_id").deviation
    assert all(by_id[i] == deviations[i] for i in (0, 7, 100, 299)) and len(by_id) == len(good)
    assert sorted(got[(got.component == 1) & got.vec_id.isna()].deviation) == [deviations[4]]


def test_whitening_in_parts_agrees_with_one_part():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (1000, 6)) + 1_000_000
    whole = whitening.moments(x)
    parts = whitening.moments(x[:1])
    for a, b in ((1, 13), (13, 13), (13, 700), (700, 1000)):
        if b > a:
            parts = parts.merge(whitening.moments(x[a:b]))
    assert parts.n == whole.n and list(parts.sums) == list(whole.sums) and np.allclose(parts.scatter, whole.scatter, rtol=1e-12)


def test_whitening_of_few_equal_huge_and_no_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(table([])).count() == 0 and whitening.whiten(table([(1, None), (2, [])])).count() == 0
    same = whitening.whiten(table([(1, [0.5, 1.0]), (1, [0.5, 1.0])])).collect()
    assert len(same) == 4 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, None, None, 0)}
    mixed = whitening.whiten(table([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [5.0]), (4, [7.0]), (5, [9.0])]))
    got = {(r.vec_id, r.component): r for r in mixed.collect()}
    assert len(got) == 7 and got[1, 2].whitened is None and got[1, 2].explained == 0 and abs(got[1, 1].whitened) == pytest.approx(1) and got[3, 1].n == 3
    assert got[1, 1].deviation == 2 * 64**2 and got[3, 1].identity_error < 1e-12
    huge = whitening.whiten(table([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 2.0])])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 3) and all(np.isfinite(r.explained) for r in huge)


# Words in chunks ---------------------------------------------------------------------------------------------------


def test_words_and_codes():
    import pyarrow as pa

    texts = ["The cat-Sat\x00on", "", None, "éÀ a1b!", "\n\n", "x" * 100_000 + " y", "last"]
    words, at = lexicon.words(pa.array(["cut", *texts]).slice(1), importance.SOLID)
    assert [words.to_pylist()[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for t in texts]
    codes, vocabulary = lexicon.encode([words, words.slice(0, 2)])
    assert vocabulary.take(pa.array(codes)).to_pylist() == words.to_pylist() + words.to_pylist()[:2]
    for x in ([], [0], [255, 0], [256], [70_000, 3], [1 << 40]):
        assert lexicon.unpacked(lexicon.packed(np.array(x, np.int64))).tolist() == x


# Importance --------------------------------------------------------------------------------------------------------


def resampled(rows, target, longest, buckets=10_000, seed=2024, least=20, percent=10):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in rows:
        n, own = features(x)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        drawn[r[:4] + (place,)] += 1
    left = Counter(r[:4] for r in out)
    left.subtract(Counter({k[:4]: 0 for k in drawn}))
    for k in drawn:
        left[k[:4]] -= 1
    return drawn + Counter({(*k, None): n for k, n in left.items() if n > 0})


@pytest.mark.parametrize("longest", [1, 3])
def test_importance(spark, longest):
    rng = np.random.default_rng(longest)
    vocabulary = ["Alpha", "beta", "gamma7", "été", "x", "y", "zz", "don't", "The"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "beta " * 100_000), (None, "alpha " * 30), (3, rows[3][1]), (1003, "\x00 only-ascii;signs"), *[(2000 + i, "zz " * 25) for i in range(150)]]
    target = ["Alpha beta beta", None, "beta x", ""]
    got = importance.resample(documents(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == resampled(rows, target, longest)


def test_importance_of_nothing(spark):
    none = documents(spark, [])
    assert importance.resample(none, none).count() == 0
    rows = [(i, "a b c " * 8) for i in range(20)]
    got = importance.resample(documents(spark, rows), none)
    assert Counter(tuple(r) for r in got.collect()) == resampled(rows, [], 1)
    assert {r["rank"] for r in got.collect()} == {None, 1, 2}


# Language model ----------------------------------------------------------------------------------------------------


def exact(c, base, slope, d):
    """Chances of 1 to c tables, by the recurrence of the generalised Stirling numbers."""
    s = np.full((c + 1, c + 2), -np.inf)
    s[1, 1] = 0
    for n in range(1, c):
        for t in range(1, n + 2):
            s[n + 1, t] = np.logaddexp(s[n, t] + np.log(n - d * t) if t <= n else -np.inf, s[n, t - 1])
    p = s[c, 1 : c + 1] + np.cumsum(np.log(base + slope * np.arange(c)))
    p = np.exp(p - p.max())
    return p / p.sum()


@pytest.mark.parametrize(("c", "base", "slope", "d"), [(1, 0.1, 0.1, 0.5), (2, 0.3, 0.1, 0.6), (5, 0.3, 0.1, 0.6), (20, 2.0, 0.01, 0.4), (90, 0.01, 0.001, 0.8), (200, 0.5, 0.01, 0.3), (300, 10.0, 0.1, 0.5), (250, 1000.0, 0.1, 0.3)])
def test_seating(c, base, slope, d):
    n, p, t = 8000, exact(c, base, slope, d), np.arange(1, c + 1)
    got = pitman_yor.seat(np.full(n, c), np.full(n, base), np.full(n, slope), d, 20, np.random.default_rng(3))
    mean, deviation = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
    assert abs(got.mean() - mean) < 0.06 * mean + 4 * deviation / math.sqrt(n) and abs(got.std() - deviation) < 0.15 * deviation + 0.1


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def model(spark, learned, scored):
    """Scores of the texts `scored`, which are held out, of a model of the texts `learned`."""
    free, taken = iter(i for i in range(10**6) if not held(i)), iter(i for i in range(10**6) if held(i))
    ids = {next(taken): t for t in scored}
    rows = [(next(free), t) for t in learned] + list(ids.items())
    got = pitman_yor.score(documents(spark, rows).repartition(4)).collect()
    return {ids[r.doc_id]: r.score for r in got if r.held_out}


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(2)
    words = ["a", "b", "c"]
    learned = [" ".join(rng.choice(words, rng.integers(0, 9), p=[0.7, 0.2, 0.1])) for _ in range(60)] + ["a " * 400, "c a " * 50]
    words.append("unseen")
    texts = ["", *words, *[f"{u} {w}" for u in words for w in words]]
    s = {t: 10**x for t, x in model(spark, learned, texts).items()}
    m = np.ones((5, 5))  # chances of the next token but for factors that cancel along any way from one end to the next
    m[0, 0] = s[""]
    for i, u in enumerate(words, 1):
        m[0, i] = s[u]
        for j, w in enumerate(words, 1):
            m[i, j] = s[f"{u} {w}"] / s[u]
    assert max(abs(np.linalg.eigvals(m))) == pytest.approx(1, abs=1e-6)


def test_language_model_learns_pairs(spark):
    rng = np.random.default_rng(4)
    after = {"sun": "shines", "rain": "falls", "wind": "blows"}
    text = lambda: " ".join(f"{k} {after[k]}" for k in rng.choice(list(after), 20))
    learned = [text() for _ in range(80)]
    s = model(spark, learned, ["sun shines rain falls", "sun falls rain shines", "shines sun falls rain"])
    assert s["sun shines rain falls"] > s["sun falls rain shines"] + 2 and s["sun shines rain falls"] > s["shines sun falls rain"] + 2


def test_language_model_counts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["A", "b", "Ca", "é", "d-d"], rng.integers(0, 30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\t "), (203, "a " * 60_000), (None, "b b\x0bnew"), (3, rows[3][1]), (3, "repeated id"), *[(300 + i, "same text here") for i in range(200)]]
    df = documents(spark, rows).repartition(6)
    got = pitman_yor.score(df).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c = Counter(w for i, t in rows if not (i is not None and held(i)) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = Counter((i, i is not None and held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    out = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got) and sum(r.score for r in out) > sum(r.base_score for r in out)
    again = pitman_yor.score(df.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 4))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_language_model_without_training(spark):
    assert pitman_yor.score(documents(spark, [])).count() == 0
    alone = [i for i in range(100) if held(i)]
    got = pitman_yor.score(documents(spark, [(i, "some words") for i in alone])).collect()
    assert len(got) == len(alone) and {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(3, 0, 0, 0.0, 0.0)}


def test_slices_answer_many_owners(spark, monkeypatch):
    """With small slices, buckets and groups the scores stay what they are up to sampling."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(30))) for i in range(60)]
    df = documents(spark, rows)
    whole = {r.doc_id: r for r in pitman_yor.score(df).collect()}
    for name, value in (("SLICE_BYTES", 1000), ("BUCKET_TOKENS", 100), ("FAN", 2)):
        monkeypatch.setattr(pitman_yor, name, value)
    for r in pitman_yor.score(df).collect():
        assert (r.n_known, r.train_tokens) == (whole[r.doc_id].n_known, whole[r.doc_id].train_tokens)
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score) and r.score == pytest.approx(whole[r.doc_id].score, rel=0.05)
