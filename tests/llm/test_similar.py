import random

import numpy as np

import corpus_pipeline as cp
from lodestrata.llm import simhash, similar

from .test_simhash import plain, roots


def sets(text, words=5):
    own = text.lower().split()
    return {tuple(own[k : k + words]) for k in range(max(len(own) - words + 1, 1))} if own else set()


def brute(texts, least=0.8, radius=14):
    s, fp = [sets(t or "") for t in texts], [plain(t, 5) for t in texts]
    near = [(a, b) for a in range(len(s)) for b in range(a) if (not s[a] and not s[b]) or (s[a] or s[b]) and len(s[a] & s[b]) >= least * len(s[a] | s[b]) and (fp[a] ^ fp[b]).bit_count() <= radius]
    return roots(len(s), near)


def made(n=120):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(3000)}"
    bases = [[word() for _ in range(rnd.randrange(20, 200))] for _ in range(12)]
    out = []
    for k in range(n):
        own = list(bases[min(k % 20, 11)])
        for _ in range(rnd.randrange(1 + len(own) // 40)):
            own[rnd.randrange(len(own))] = word()
        out.append(" ".join(own))
    return [*out, "one two", "One  two", "three", "", None, " "]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 9)
    monkeypatch.setattr(simhash, "WIDE", 7)
    texts = made()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_copies(df).collect()}
    want = brute(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert len(set(want)) > 15


def test_blocks_of_a_tile_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    texts = made()
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, *rows[:40], (None, texts[0])], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in similar.near_copies(df).collect()]
    want = brute(texts)
    assert sorted(got, key=str) == sorted([*enumerate(want), *[(k, want[k]) for k in range(40)], (None, want[0])], key=str)


def test_spanning():
    label = simhash.spanning(np.array([5, 3, 7, 1]), np.array([3, 9, 8, 2]), 10)
    assert label.tolist() == [0, 1, 1, 3, 4, 3, 6, 7, 7, 3]


def test_stage_drops_near_copies(spark, tiny):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(9999)}" for _ in range(300)]
    near, far = list(words), list(words)
    for k in range(5):  # 25 of 296 shingles: similarity 271/321
        near[50 * k + 20] = "other"
    for k in range(15):  # below 0.8
        far[20 * k + 3] = "other"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, df, tiny).collect()) == [1, 3]


def test_stage_on_standard_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").dropDuplicates(["text"])
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    top = brute([t for _, t in rows])
    want = {i for k, (i, _) in enumerate(rows) if top[k] == k}
    assert {r.doc_id for r in cp.near_dedup(spark, docs, tiny).collect()} == want
    assert len(want) < len(rows)


def test_sketches_allow_every_pair_of_the_similarity():
    rng = np.random.default_rng(5)
    far = 0
    for n in (1, 2, 5, 9, 40, 130, 1000, 20_000):
        for _ in range(30):
            own = np.unique(rng.integers(0, 2**64, n, np.uint64))
            # From equal sets to a similarity of just 0.8, part of it by members one has more.
            lost, more = rng.integers(0, n // 9 + 1, 2)
            other = np.unique(np.concatenate((own[lost:], rng.integers(0, 2**64, more, np.uint64))))
            alone = rng.integers(0, 2**64, n, np.uint64)
            one, two, three = (simhash.sketch(x, 0.8) for x in (own, other, alone))
            words = min(map(len, (one, two, three)))
            rows = simhash.folded(np.concatenate((one, two, three)), np.cumsum([0, len(one), len(two), len(three)]), words)
            bits = np.bitwise_count(rows[0] ^ rows[1:]).sum(axis=1)
            common = len(np.intersect1d(own, other))
            assert bits[0] <= len(own) + len(other) - 2 * common
            if similar.alike(np.array(common), np.array(len(own)), np.array(len(other)), 0.8):
                assert bits[0] <= simhash.apart(0.8) * (len(own) + len(other)) + 1e-6
            far += n > 9 and bits[1] > simhash.apart(0.8) * (n + n)
    assert far == 4 * 30


def test_texts_near_by_chance_form_no_cluster(spark, monkeypatch):
    """Chance brings fingerprints within the radius, for more texts the more there are; here for all."""
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(100, 140))) for _ in range(300)]
    texts += [t + " more" for t in texts[:20]]
    read, true = [], similar._sets

    def counted(docs, words):
        read.append(docs.count())
        return true(docs, words)

    monkeypatch.setattr(similar, "_sets", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_copies(df, radius=64).collect()}
    assert got == {k: k if k < 300 else k - 300 for k in range(320)}
    assert read == [40]
