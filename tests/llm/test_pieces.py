import itertools
import random

import pytest
import sentencepiece

from lodestrata.llm import pieces
from lodestrata.llm.queries import VOCABULARY, op7_sentencepiece

np = pytest.importorskip("numpy")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)


CASES = ["", " ", "a", " a", "a ", "Hello  world\n new\tline   x    y", "ﬁ　x é 日本語 🎉🎉", "\n\n  \n", "            deep", "x" * 200, "0123 4567890", "a b​c", "Ünïcödé straße", "'\"!!" * 9]


def ids(packed):
    return np.frombuffer(packed, np.int32).tolist()


def test_same_as_library(vocabulary, library):
    for text in CASES:
        got = vocabulary.encode([text])[0]
        assert ids(got) == library.encode(text), text
        assert vocabulary.decode(np.frombuffer(got, np.int32)) == text


def test_corpus_same_as_library(spark, vocabulary, library, tiny):
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = vocabulary.encode(texts)
    assert [ids(g) for g in got] == library.encode(texts)


def test_marks_in_text(vocabulary):
    for text in ("▁", "a▁b", "▁ ▁x ", " ▁"):
        assert vocabulary.decode(np.frombuffer(vocabulary.encode([text])[0], np.int32)) == text


def test_small_slices(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 5)
    monkeypatch.setattr(pieces, "KEPT", 3)
    assert [ids(g) for g in vocabulary.encode(CASES)] == library.encode(CASES)


def test_viterbi_of_unigram_scores():
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("ab▁") for _ in range(rnd.randrange(1, 4))) for _ in range(30)} | {"a", "b", "▁"})
    scores = [-rnd.random() * 10 - 1 for _ in words]
    v = pieces.Vocabulary([*words, "<unk>"], [*scores, 0.0], [*["piece"] * len(words), "unknown"], merges=False)
    for n in range(1, 9):
        for w in itertools.islice(itertools.product("ab", repeat=n), 0, None, 7):
            word = "".join(w)
            got = [words[k] for k in ids(v.encode_words({word})[word])]
            cuts = [[word[a:b] for a, b in itertools.pairwise([0, *c, n])] for r in range(n) for c in itertools.combinations(range(1, n), r)]
            best = max(sum(scores[words.index(p)] for p in c) for c in cuts if all(p in words for p in c))
            assert "".join(got) == word and abs(sum(scores[words.index(p)] for p in got) - best) < 1e-9


def test_rows(spark, vocabulary):
    rows = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    got = pieces.summary(df, vocabulary).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_ids for r in got}[1] == 0
    assert pieces.summary(df.where("false"), vocabulary).collect() == []
    both = pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()
    assert all(r.decoded == r.text for r in both)
    assert {(r.doc_id, r.ids_sha256) for r in both} == {(r.doc_id, r.ids_sha256) for r in got}
    assert [r.ids for r in pieces.encode(df, vocabulary).where("doc_id < 3").orderBy("doc_id").collect()] == [None, []]


def test_query(spark, tiny, library):
    got = {r.doc_id: r for r in op7_sentencepiece(spark, tiny).collect()}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        assert got[r.doc_id].round_trip and got[r.doc_id].n_ids == len(library.encode(r.text))
