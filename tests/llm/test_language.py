import math
import zlib
from collections import Counter

import pytest

from lodestrata.llm import language
from lodestrata.llm.queries import op4_language


def test_query(spark, tiny):
    got = op4_language(spark, tiny).collect()
    want = {r.doc_id: r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_edges(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "le chat et le chapeau", "fr"), (3, None, "fr"), (4, "12 34", None), (5, "", "en"), (None, "le chat", None), (2, "le chat et le chapeau", "fr")]
    rows.append((6, "the cat sat " * 300_000, "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as bucket")
    model = language.train(df.where('doc_id is null or doc_id < 6'))
    got = language.identify(df.select("doc_id", "text", "lang_pred"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert {k: by[k].lang_pred for k in (1, 2, 3, 4, 5, 6, None)} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", 6: "en", None: "fr"}
    assert by[4].score == 0 and by[6].score > 0.99
    nothing = language.train(df.where("false"))
    assert {r.lang_pred for r in language.identify(df.select("text"), nothing).collect()} == {"und"}
    assert language.identify(df.where("false").select("text"), model).collect() == []


def test_pieces_agree():
    model = language.Model(["a", "b"], __import__("numpy").random.default_rng(0).normal(size=(1 << 16, 2)).astype("float32"))
    text = "words of some kind " * 3
    assert model.score([text])[0] == model.score([None, text, "x"])[0][1:2]


def plain_grams(text):
    """Whole text at once, one n-gram after another."""
    c = [ord(x) if x.isalpha() else 32 for x in text.lower()]
    c = [x for x, before in zip([32, *c, 32], [0, 32, *c], strict=True) if x != 32 or before != 32]
    if len(c) < 3:
        return []
    out = []
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            key = 0
            for x in c[i : i + n]:
                key = (key * 0x110001 + x) % 2**64
            mixed = (key + n) * 0x9E3779B97F4A7C15 % 2**64
            mixed = (mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
            out.append(mixed >> 48)
    return sorted(out)


@pytest.mark.parametrize("text", ["", " ", "a", "  ab  c1d ", "The İ cat ẞ and 12 more... ", "x" * 9, "no end here", "12 34"])
def test_slices_equal_the_whole(text, monkeypatch):
    want = plain_grams(text)
    for size in (1 << 20, 1, 2, 3, 5, len(text) or 1):
        monkeypatch.setattr(language, "SLICE", size)
        assert sorted(language.grams(text).tolist()) == want


def test_against_plain_bayes(spark, tiny):
    """Counts, smoothing and posteriors of every document, computed again without the operator's code."""
    docs = [r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    counts = {}
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    langs = sorted(counts)
    sums = {k: sum(counts[k].values()) + 0.01 * 65536 for k in langs}
    got = {r.doc_id: r for r in op4_language(spark, tiny).collect()}
    for r in docs:
        own = Counter(plain_grams(r.text or ""))
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        logs = [sum(n * math.log((counts[k][g] + 0.01) / sums[k]) for g, n in own.items()) for k in langs]
        best = max(logs)
        assert got[r.doc_id].lang_pred == langs[logs.index(best)]
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(max(x - best, -700)) for x in logs)) < 1e-3


def test_too_many_languages(spark):
    df = spark.createDataFrame([(f"l{k}", "some text") for k in range(5)], "lang string, text string")
    with pytest.raises(ValueError, match="more than 4"):
        language.train(df, most=4)
    assert len(language.train(df, most=5).langs) == 5
