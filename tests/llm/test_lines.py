import random
import re

import pytest

from lodestrata.llm.lines import dedup_lines
from lodestrata.llm.queries import op5_lines


def brute(docs, least):
    """All pairs of places: the longest earlier equal run from each line."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, __import__("hashlib").sha256((d[1] or "").encode()).hexdigest()))
    seq = []
    for n, (_, t) in enumerate(order):
        for k, x in enumerate((t or "").split("\n")):
            words = len(re.findall(r"[^\x20\x09-\x0D]+", x))
            if words:
                seq.append((n, k, x, words))
        seq.append((n, -1, object(), 0))
    dead = set()
    for i in range(len(seq)):
        for j in range(i):
            m = 0
            while i + m < len(seq) and seq[i + m][2] == seq[j + m][2]:
                m += 1
            if m and sum(x[3] for x in seq[i : i + m]) >= least:
                dead |= {(x[0], x[1]) for x in seq[i : i + m]}
    out = {}
    for n, d in enumerate(order):
        lines = (d[1] or "").split("\n")
        kept = [x for k, x in enumerate(lines) if (n, k) not in dead]
        gone = len(lines) - len(kept)
        text = d[1] if not gone else "\n".join(kept) if any(re.search(r"[^\x20\x09-\x0D]", x) for x in kept) else ""
        out[d] = (text, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines), gone)
    return [out[d] for d in docs]


def run(spark, docs, least):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, h int").selectExpr("*", "1 as rank")
    got = {r.h: (r.text, r.n_lines, r.n_deleted) for r in dedup_lines(df, least).collect()}
    return [got[n] for n in range(len(docs))]


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 9), (3, 1)])
def test_against_brute_force(spark, seed, least):
    rnd = random.Random(seed)
    vocab = ["a", "b b", "c c c", "", "  ", "d", "e e e e e e"]
    runs = [[rnd.choice(vocab) for _ in range(rnd.randrange(1, 12))] for _ in range(6)]
    docs = []
    for k in range(28):
        lines = []
        for _ in range(rnd.randrange(4)):
            lines += rnd.choice([rnd.choice(runs), [f"own {k} {rnd.random()}"], [rnd.choice(vocab)]])
        docs.append((k * 3 % 31, "\n".join(lines)))
    docs += [(100, docs[3][1]), (2, docs[5][1]), (docs[4][0], docs[4][1]), (docs[0][0], docs[1][1]), (200, None), (201, ""), (202, "\n\n"), (None, docs[6][1])]
    assert run(spark, docs, least) == brute(docs, least)


def test_periodic_and_long(spark):
    docs = [(1, "x y\n" * 400), (2, "x y\n" * 150 + "tail"), (3, "w " * 60), (4, "head\n" + "w " * 60 + "\nend")]
    got = run(spark, docs, 50)
    assert [g[2] for g in got] == [399, 150, 0, 1]
    assert got[3][0] == "head\nend" and got[1][0] == "tail" and got[0][0] == "x y\n"


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert run(spark, [(1, "only one")], 50) == [("only one", 1, 0)]


def test_query(spark, tiny):
    df = op5_lines(spark, tiny)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()]
    want = dict(zip([d[0] for d in docs], brute(docs, 50), strict=True))
    assert {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in df.collect()} == want
