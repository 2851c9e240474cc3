import sentencepiece

import corpus_pipeline as cp
from lodestrata.llm.queries import VOCABULARY

from .test_decontaminate import brute as brute_hits
from .test_lines import brute as brute_lines
from .test_similar import brute as brute_near


def test_stages(spark, tiny):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokenise"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    now = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]

    # Each stage on all that the one before kept, against a plain version.
    one = cp.language_id(spark, docs, tiny)
    assert one.columns == docs.columns
    got = {r.doc_id: r.text for r in one.collect()}
    assert got == {i: t for i, t in now.items() if any(c.isalpha() for c in t)}
    given = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.lang == given[r.doc_id] for r in one.collect() if given[r.doc_id])

    order = sorted(got.items())
    lines = dict(zip([i for i, _ in order], brute_lines(order, 50), strict=True))
    want = {i: t for i, (t, _, gone) in lines.items() if t.strip() or not gone}
    two = cp.line_dedup(spark, one, tiny).persist()
    assert two.schema == docs.schema
    assert {r.doc_id: r.text for r in two.collect()} == want
    assert all(r.n_chars == len(r.text) for r in two.collect() if r.text != now[r.doc_id])

    ids = sorted(want)
    top = brute_near([want[i] for i in ids])
    want = {i: want[i] for k, i in enumerate(ids) if top[k] == k}
    three = cp.near_dedup(spark, two, tiny).persist()
    assert three.columns == docs.columns
    assert {r.doc_id: r.text for r in three.collect()} == want

    want = {i: t for i, t in want.items() if not brute_hits(t, items)[2]}
    four = cp.decontamination(spark, three, tiny)
    assert four.columns == docs.columns
    assert {r.doc_id: r.text for r in four.collect()} == want

    library = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    last = cp.run(spark, tiny).collect()
    assert {r.doc_id: r.ids for r in last} == {i: library.encode(t) for i, t in want.items()}
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in last)


def test_odd_rows(spark, tiny):
    text = "the river and the bridge are near the old school of the town "
    rows = [(1, text * 8, "en", "a", 9), (1, text * 8, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "12 !", "en", "b", 4), (None, text * 8, "en", "b", 1), (None, "other words here", None, "c", 1), (5, text * 9, "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as h", "2 as component_id", "3 as _id", "4 as id", "'own' as score", "7 as n_words", "8 as n_deleted", "'q' as hit_items", "9 as lang_pred")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert {(r.h, r.component_id, r.score, r.n_words, r.n_deleted, r.hit_items, r.lang_pred) for r in docs.collect()} == {(1, 2, "own", 7, 8, "q", 9)}
    got = cp.tokenise(spark, docs, tiny).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"] or sorted(str(r.doc_id) for r in got) == ["1", "5", "None"]
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, tiny)
    assert empty.collect() == []
