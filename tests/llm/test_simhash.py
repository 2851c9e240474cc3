import random

import numpy as np
import pytest
import xxhash

from lodestrata.llm import simhash
from lodestrata.llm.components import connected_components


def plain(text, n=3):
    words = simhash._space.sub(b" ", (text or "").encode().lower()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "a b\x0bc\x0cd  e A B", "é à ü É a b c d", "x " * 5])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text) == plain(text)
    monkeypatch.setattr(simhash, "PIECE", 3)
    assert simhash.fingerprint(text) == plain(text)


def test_fingerprint_long(monkeypatch):
    rnd = random.Random(2)
    text = " ".join(str(rnd.randrange(500)) for _ in range(3000))
    want = plain(text)
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(text) == want


def test_spark_hash_is_the_same(spark):
    r = spark.sql("select xxhash64('a b c') h").first()
    assert r.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(30)]
    for _ in range(400):
        fps.append(rnd.choice(fps) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps += [0, 1, 2**64 - 1, *fps[:20]]
    ids = list(range(10, 10 + len(fps)))
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs.selectExpr("doc_id as id", "fp"))
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in zip(ids, fps)], "doc_id long, fp long")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert [got[i].component_id for i in ids] == [10 + w for w in want]
    assert [got[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (3, " "), (9, "some words here and there"), (None, "some words here and there"), (9, "some words here and there"), (None, "other words than these ones")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as u", "3 as id")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.fingerprint == "0" * 16) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1, False), (-1, 9, False), (3, 3, True), (4, 3, True), (5, 3, True), (9, 9, False), (9, 9, False)]
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_components(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    links = chain + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 340)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots(400, links)
    assert got == {n: want[n] for e in links for n in e if any(n in x and x[0] != x[1] for x in links)}
