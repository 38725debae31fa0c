"""Document operators against brute force: near-duplicates, passages, personal data, quality, packing, mixing."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import minhash, mixing, packing, pii, quality, substring

SCHEMA = "doc_id long, text string, source string, n long, key string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, shared = say(120), say(60)
    texts = [None, "", " \n\t", "one", "One", "a b c d", "x" * 50_000, "é ü 😀 " * 30]
    texts += [" ".join(base)] * 3 + [" ".join(base).upper()]
    for k in range(12):  # near copies with more and more edits
        w = list(base)
        for i in rng.sample(range(120), k):
            w[i] = "edited"
        texts.append(" ".join(w))
    for _ in range(5):
        texts.append(" ".join(say(40) + shared + say(40)))
    texts += [" ".join(say(rng.randint(5, 200))) for _ in range(10)] + [" ".join(say(6000))]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    rows = [(i, t, ["a", "b", None][i % 3], 1, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id at all here", "a", 1, "k"), rows[-1]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_minhash(spark, docs):
    texts = corpus()
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in label:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def components(sets, n):
    label = list(range(n))
    linked = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in label:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_minhash_of_large_sets_and_without_broadcasts(spark, monkeypatch):
    """Sets around the limit of thinning, here 512 shingles, and the branch of tables that are too large to broadcast."""
    from weft.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = random.Random(9)
    texts = []
    for n in (300, 420, 500, 530, 600, 900, 4000, 24_000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        cut = [base, base[: int(n * 0.8)], base[: int(n * 0.6)], [w if k % 60 else "edited" for k, w in enumerate(base)]]
        texts += [" ".join(x) for x in cut]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    label = components(sets, len(texts))
    got = minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), large=512).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label)) and len(set(label)) < len(texts)


def test_levels_of_thinning():
    assert minhash.levels(1) == minhash.levels(180_000) == [0] and minhash.levels(200_000) == [0, 1] and minhash.levels(300_000) == [1]
    for n in (10, 1 << 17, 1 << 18, (1 << 18) + 1, 10**7, 1 << 24, 10**9):
        assert set(minhash.levels(n)) & set(minhash.levels(n * 3 // 4 + 1))


def test_circulant_signature():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, int(2000 * share)).astype(np.uint64)
        rest = rng.integers(0, 1 << 63, 2000 - len(both)).astype(np.uint64)
        half = len(rest) // 2
        a, b = (minhash.signature(np.concatenate([both, x])) for x in (rest[:half], rest[half:]))
        assert abs((a == b).mean() - share) < 0.12


def test_repeated_passages(spark, docs):
    texts = corpus()
    found = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 49):
            found.setdefault(tuple(w[k : k + 50]), set()).add(i)
    covered = {}
    for i, t in enumerate(texts):
        w = words(t)
        covered[i] = {p for k in range(len(w) - 49) if len(found[tuple(w[k : k + 50])]) > 1 for p in range(k, k + 50)}
    got = {i: set() for i in covered}
    for r in substring.repeated(docs).collect():
        assert r.end_word <= len(words(texts[r.doc_id])) and r.n_words == r.end_word - r.start_word >= 50
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert all(covered[i] <= got[i] for i in covered)
    clean = [i for i in covered if not covered[i] and not 8 <= i < 24]
    assert not any(got[i] for i in clean)
    assert substring.repeated(empty(spark)).count() == 0


def passage_recall(spark, pairs, others=(), **options):
    """The share of documents of which most of the planted passage, given as (text, start, end), is returned."""
    flat = [d for pair in pairs for d in pair]
    rows = [(i, " ".join(d[0])) for i, d in enumerate([*flat, *((o, 0, 0) for o in others)])]
    got = {}
    for r in substring.repeated(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert not any(i in got for i in range(len(flat), len(rows)))
    return np.mean([len(got.get(i, set()) & set(range(a, b))) >= 0.9 * (b - a) for i, (_, a, b) in enumerate(flat)])


def test_repeated_passages_with_inserted_word(spark):
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    pairs = []
    for k in range(40):
        n = (90, 60)[k % 2]
        p = say(n)
        q = p[: n // 2] + say(1) + p[n // 2 :] if k % 4 < 2 else p[: n // 2] + p[n // 2 + 1 :]
        pairs.append([(say(70) + p + say(50), 70, 70 + n), (say(40) + q + say(90), 40, 40 + len(q))])
    assert passage_recall(spark, pairs) == 1


def test_repeated_passages_with_one_substitution(spark):
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    pairs = []
    for k in range(60):
        n = (60, 52)[k % 2]
        p = say(n)
        pairs.append([(say(70) + p + say(50), 70, 70 + n), (say(40) + p[: n // 2] + say(1) + p[n // 2 + 1 :] + say(90), 40, 40 + n)])
    assert passage_recall(spark, pairs) >= 0.95


def test_repeated_passages_inside_a_mixed_group(spark):
    rng = random.Random(13)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrase, pairs = say(30), []
    for _ in range(40):
        p = say(15) + phrase + say(15)
        pairs.append([(say(70) + p + say(50), 70, 130), (say(40) + p[:12] + say(1) + p[13:] + say(90), 40, 100)])
    others = [say(60) + phrase + say(60) for _ in range(120)]
    assert passage_recall(spark, pairs, others, members=32) >= 0.95


def test_anchors_and_windows():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    values[200:300] = np.tile(values[200:210], 10)  # a line that repeats
    starts = np.array([0, 0, 90, 95, 400, 400])
    for length in (3, 16, 46):
        places = substring.anchors(values, starts, length)
        true = {a + k + int(o) for a, b in zip(starts[:-1], starts[1:], strict=True) for k in range(b - a - length + 1) for o in np.flatnonzero(values[a + k : a + k + length] == values[a + k : a + k + length].min())}
        assert set(places.tolist()) == true
        kept = substring.thinned(places, values, starts, length)
        assert set(kept.tolist()) <= true
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            for k in range(a, b - length + 1):  # each window keeps a place of its minimum
                assert any(k <= p < k + length and values[p] == values[k : k + length].min() for p in kept)
        before, after = substring.extents(values, kept, starts, 20)
        for p, x, y in zip(kept.tolist(), before.tolist(), after.tolist(), strict=True):
            a, b = next((a, b) for a, b in zip(starts[:-1], starts[1:], strict=True) if a <= p < b)
            assert x == next((k for k in range(20) if p - k - 1 < a or values[p - k - 1] < values[p]), 20)
            assert y == next((k for k in range(20) if p + k + 1 >= b or values[p + k + 1] < values[p]), 20)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(only(m[0])) <= 15]


def test_personal_data(spark):
    texts = ["a@b.c+d@e.f.g x@@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0004 1.2.3", "4111 1111 1111 1111 4111111111111111-1 12  4111111111111111", "+1 (555) 123-4567) +1 2 3 +44 20 7946 0958 8 ++12345678901", None, "", "ünïcödé 😀 a.b@c.de 10.0.0.1 😀 +49 30 1234567.", "x" * 50_000 + "@" + "y" * 5_000, "1" * 20_000, "a@b" + ".c" * 5_000]
    df = spark.createDataFrame([*enumerate(texts), (None, "1.1.1.1"), (0, texts[0])], "doc_id long, text string")
    got = pii.find(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "1.1.1.1" if r.doc_id is None else texts[r.doc_id] or ""
        spans = base_spans(text)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and r.spans == shown
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in spans) for x in ("email", "ip", "card", "phone")]
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[4] is None and masked[6] == "ünïcödé 😀 <email> <ip> 😀 <phone>." and masked[None] == "<ip>"
    assert pii.find(df.limit(0)).count() == 0


def test_personal_data_discovered(spark):
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(["tree", "house", "walk", "seven", "river", "and", "green"]) for _ in range(n))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    known, planted, clean = [], {}, []
    for i in range(30):
        known.append(f"{say(20)} please write to user{i}@mail{i}.example.org today {say(5)}")
        known.append(f"{say(9)} his number is +49 30 {rng.randrange(10**6, 10**7)} since {say(9)}")
        known.append(f'{say(4)} api token = "{key()}" {say(9)}')
    for i in range(20):
        kind, before, token, behind = [("email", "please write to ", f"agent_{i}-x", " today"), ("phone", "his number is ", f"030/{rng.randrange(10**6)}", " since then"), ("secret", 'api token = "', f"Zq9{i}-K{rng.randrange(10**6)}", '"')][i % 3]
        text = f"{say(7)} {before}"
        planted[f"{text}{token}{behind} {say(4)}"] = f"{kind}:{len(text)}:{len(text) + len(token)}"
        clean.append(f"{say(5)} chapter page 4{i} today, {say(3)} version {i}.2 {say(3)}")
    texts = [*known, *planted, *clean]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    hits = [got[i].spans == planted[t] for i, t in enumerate(texts) if t in planted]
    assert np.mean(hits) >= 0.95
    assert not any(got[i].spans for i, t in enumerate(texts) if t in clean)  # precision 1 here
    assert all("secret:" in got[i].spans for i in range(2, 90, 3))


def test_repeated_passages_of_great_length(spark):
    """Windows reach further than 255 places."""
    rng = random.Random(300)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: [word() for _ in range(n)]
    shared, short = line(330), line(280)
    rows = [(k, " ".join(line(40) + shared + line(60))) for k in range(3)] + [(10 + k, " ".join(line(40) + short + line(60))) for k in range(3)]
    got = {r.doc_id: r for r in substring.repeated(spark.createDataFrame(rows, "doc_id long, text string"), least=300).collect()}
    assert {i: (r.start_word, r.end_word) for i, r in got.items()} == dict.fromkeys(range(3), (40, 370))
    values = np.concatenate([np.arange(1, 400)[::-1], np.arange(400)]).astype(np.uint64)
    before, after = substring.extents(values, np.array([399]), np.array([0, len(values)]), 311)
    assert before.tolist() == [311] and after.tolist() == [311]


def test_personal_data_of_dense_texts(spark):
    import time

    texts = ["1.1.1.1 " * 16_000, "a@b.c " * 3000 + "word " * 3000, "x1 " * 20_000]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    pii.find(df.limit(0)).count()
    begun = time.time()
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert (got[0].n_ip, got[1].n_email) == (16_000, 3000) and got[0].spans.endswith("ip:127992:127999")
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked == {0: "<ip> " * 16_000, 1: "<email> " * 3000 + "word " * 3000, 2: texts[2]}
    assert time.time() - begun < 60


def test_personal_data_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de", 1, "x", 2, "y", "z"), (1, None, 1, None, 2, "y", "z"), (2, f"key {'0a' * 20} here", 1, "x", 2, "y", "z")], "doc_id long, text string, k1 int, k2 string, spans int, base string, id string")
    assert sorted(str(r.text) for r in pii.mask(df).collect()) == ["None", "key <secret> here", "mail <email>"]
    assert pii.mask(df).columns == df.columns and pii.find(df).count() == 3


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and"]) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(20, 200)))
    bad = lambda: " ".join(["BUY!!"] * rng.randint(20, 200))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (None, good()), (3, good()), (1002, "x " * 40_000)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) >= 0.95
    assert quality.score(spark.createDataFrame([], "doc_id long, text string"), labels.limit(0)).count() == 0


def test_quality_by_plain_formula(spark):
    """Scores from two covariances, their determinants and inverses, on the same statistics."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma.", "10", "of", "||", "and!"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    label = {i: int(rng.random() < 0.6) for i in range(0, 300, 2)}
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(df, spark.createDataFrame(list(label.items()), "doc_id long, quality int")).collect()}
    x = quality.statistics(pa.array(texts))
    own = [x[[i for i, y in label.items() if y == k and zlib.crc32(str(i).encode()) % 5]] for k in (0, 1)]
    cov = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) * c for o, c in zip(own, cov, strict=True)) / sum(map(len, own))
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    log = []
    for k in (0, 1):
        s = ((1 - quality.SHRINK_POOLED) * cov[k] + quality.SHRINK_POOLED * pooled) / np.outer(scale, scale)
        s = (1 - quality.SHRINK_DIAGONAL) * s + quality.SHRINK_DIAGONAL * np.eye(len(s))
        d = (x - own[k].mean(0)) / scale
        log.append(np.log((len(own[k]) + 1) / (sum(map(len, own)) + 2)) - 0.5 * np.einsum("ni,ni->n", d, np.linalg.solve(s, d.T).T) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(log[0] - log[1]))
    assert max(abs(got[i] - want[i]) for i in got) < 1e-9


def test_quality_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1.0, 2), (2, "d e f!", "x", 1.0, 2)], "doc_id long, text string, id string, score double, label int")
    labels = spark.createDataFrame([(1, 1, "y"), (2, 0, "y")], "doc_id long, quality int, label string")
    assert sorted(r.doc_id for r in quality.score(df, labels).collect()) == [1, 2]


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(enumerate(corpus())) | {None: "no id at all here"}
    got = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids = np.array([*reference.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        copies = 2 if i == len(corpus()) - 1 else 1
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(empty(spark)).count() == 0


def test_packing_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext| >"]
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).filter("start = 0").collect()}
    for i, t in enumerate(texts):
        ids = np.array([*reference.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[i].doc_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(ids[: got[i].length].tobytes())


def test_packing_of_very_long_runs(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: " " * 2_000_000, 2: "\n" * 2_000_000, 3: "a" * 2_000_000, 4: "word <|endoftext|>" + " " * 1_100_000 + "x"}
    pieces = {}
    for r in packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, own in pieces.items():
        ids = np.array([*reference.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert pieces.keys() == texts.keys()


def test_packing_plan():
    rng = np.random.default_rng(2)
    histogram = np.bincount(rng.integers(1, 64, 5000), minlength=64)
    p = packing.plan(histogram)
    assert p["used"].sum() > 0.8 * histogram.sum() and (p["used"] <= histogram).all()
    for length in range(1, 64):
        own = p["length"] == length
        assert p["count"][own].sum() == p["used"][length]


def test_mixing(spark, docs):
    got = mixing.mix(docs, block_words=16).collect()
    again = mixing.mix(docs, block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
    sizes, target, taken = {}, {}, {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        s = source[r.doc_id]
        assert r.taken <= 3 * r.size
        sizes[s], target[s], taken[s] = sizes.get(s, 0) + r.size, r.target, taken.get(s, 0) + r.taken
    total = sum(sizes.values())
    weight, capped = {"a": 1, "b": 2, None: 3}, set()
    while True:  # the contract's own words
        rest, weights = total - sum(3 * sizes[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in weight if s not in capped and rest * weight[s] / weights > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in weight:
        assert target[s] == pytest.approx(3 * sizes[s] if s in capped else rest * weight[s] / weights)
        assert abs(taken[s] - target[s]) <= 32
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_of_small_sources(spark):
    rows = [(f"s{n:03}", n) for n in (1, 2, 10, 31, 33, 63, 64, 65, 100, 30, 30, 7)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), f"{s}_{i}") for i, (s, n) in enumerate(rows)] + [(99, " ".join(["w"] * 5000), "z")], "doc_id long, text string, source string")
    for r in mixing.mix(df).collect():  # one document a source
        assert abs(r.taken - r.target) <= 1 or r.doc_id == 99


def test_apportionment(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    for n, seats in ((1, 7), (5, 3), (7, 0), (40, 1000), (30, 11)):
        votes = [(i, float(rng.choice([0, 1, 5, 100, 3000]) * rng.random())) for i in range(n)]
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in votes if v for k in range(seats)))[:seats]
        df = spark.createDataFrame([(i, v, seats) for i, v in votes], "i int, v double, s long")
        got = {r.i: r.out for r in mixing.apportion(df, [], "v", "s", [F.col("i").asc()], "out").collect()}
        assert got == {i: sum(x == i for _, x in quotients) for i, v in votes if v}


def test_verify_aligns_only_what_may_hold_a_passage(monkeypatch):
    """Pairs of ranges that share fewer shingles than two shortest passages do are dropped by counting, all others are compared as before."""
    rng = np.random.default_rng(7)
    sides, expected = [], []
    for k in range(200):
        a = rng.integers(0, 1 << 32, 100).astype(np.uint32)
        b = np.concatenate([rng.integers(0, 1 << 32, 20).astype(np.uint32), a[: 60 if k % 4 == 0 else 20]])
        if k % 8 == 0:
            b = np.insert(b, 50, 1)  # not on one diagonal
        sides.append((a, b))
        expected += [(k, s, e) for s, e, *_ in substring.passages(a, b, 46, 75, 100)]
    calls = []
    true = substring.aligned
    monkeypatch.setattr(substring, "aligned", lambda *x: calls.append(1) or true(*x))
    n = len(sides)
    fields = {"id": pa.array(np.arange(n)), "hub": pa.array(np.arange(n) + n), "delta": pa.array(np.zeros(n, np.int64)), "lo": pa.array(np.zeros(n, np.int64)), "lo2": pa.array(np.zeros(n, np.int64)), "own": pa.array([a.tobytes() for a, _ in sides]), "other": pa.array([b.tobytes() for _, b in sides])}
    got = pa.Table.from_batches(list(substring._verify(46, 75, 100, [pa.RecordBatch.from_pydict(fields)]))).to_pylist()
    assert [(r["id"], r["s"], r["e"]) for r in got if r["id"] < n] == expected and len({k for k, *_ in expected}) == 50
    assert len(calls) <= 50
    repeats = [np.array(x, np.uint32) for x in ([7] * 40 + [8] * 5, [7] * 2 + [8] * 50)]
    assert substring._common(pa.array([repeats[0].tobytes(), b""]), pa.array([repeats[1].tobytes(), b"abcd"])).tolist() == [7, 0]
