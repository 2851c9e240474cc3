import random
import re

import pytest

from lodestrata.llm import decontaminate as dc
from lodestrata.llm.queries import op6_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n=8):
    w = split(text)
    hit, ids = set(), set()
    for item, t in items:
        v = split(t)
        if not v or item is None:
            continue
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                ids.add(str(item))
    return len(w), len(hit), len(ids), dc.sha(list(ids)), len(ids) >= 2


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    vocab = ["a", "be", "Ça", "d1", "éé", "F", "日本", "x9"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, say(rnd.randrange(9, 30))) for k in range(12)] + [(50, "F, be!"), (51, None), (52, ""), (53, "..."), (None, say(9)), (3, say(12)), (54, say(8))]
    docs = [(k, " ".join(rnd.choice([say(6), rnd.choice(items)[1] or "-", say(3).upper() + "\n"]) for _ in range(rnd.randrange(8)))) for k in range(80)]
    docs += [(900, None), (901, ""), (902, "?!"), (903, say(5000)), (5, docs[5][1]), (None, items[0][1])]
    return docs, items


def rows(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()))


@pytest.mark.parametrize("set_bytes,piece", [(1 << 20, 1 << 20), (300, 50)])
def test_against_brute_force(spark, case, monkeypatch, set_bytes, piece):
    monkeypatch.setattr(dc, "PIECE", piece)
    docs, items = case
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'q' as item_id", "2 as n_hit", "3 as contaminated", "4 as digest", "5 as own_digest")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_hits(d, b, set_bytes=set_bytes)
    # However many sets there are, a task runs one Python worker for each step, never one for each set.
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
    out = dc.summary(found)
    assert len(set(out.columns)) == len(out.columns)
    assert {(r.item_id, r.digest, r.own_digest) for r in out.collect()} == {("q", 4, 5)}
    got = rows(out)
    want = sorted((-1 if i is None else i, *brute(t, items)) for i, t in docs)
    assert got == want
    assert any(x[2] for x in want) and any(not x[2] for x in want)


def test_pieces(case, monkeypatch):
    docs, items = case
    monkeypatch.setattr(dc, "PIECE", 7)
    table = dc.Windows([(str(i), t) for i, t in items if i is not None and t])
    for i, t in docs:
        n, runs, ids = table.find([t])[0]
        assert (n, sum(b - a for a, b in runs), len(ids)) == brute(t, items)[:3]


def test_removal(spark, case):
    docs, items = case
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = dc.decontaminate(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(brute(t, items)[2] == 0 for _, t in docs)
    cut = {r.doc_id: r.text for r in dc.decontaminate(d, b, spans=True).collect()}
    assert len(cut) == len({i for i, _ in docs})
    for i, t in docs:
        if t is None or not brute(t, items)[1]:
            assert cut[i] == t
        else:
            assert len(split(cut[i])) == brute(t, items)[0] - brute(t, items)[1]


def test_empty(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert rows(dc.summary(dc.find_hits(d, b))) == [(1, 2, 0, 0, dc.sha([]), False)]
    assert dc.find_hits(d.where("false"), b).collect() == []


def test_query(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert rows(op6_decontaminate(spark, tiny)) == sorted((i, *brute(t, items)) for i, t in docs)
