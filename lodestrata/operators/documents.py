"""Bags of words: histograms, TF-IDF and cosine similarity of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemmer import with_stems
from ..functions.text import split_words, strip_html

#: English function words that carry no topic; a store adds words of its own subject.
STOP_WORDS = "a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its like more most my no not of on one only or other our out over she should so some such than that the their them then there these they this those to two under until up very was we were what when where which while who will with would you your".split()
DOMAIN_WORDS = "data dataset statistics published information number area authority england wales".split()


def words_of(docs: DataFrame, doc: str, text: str, html: bool = False, shortest: int = 3) -> DataFrame:
    """doc, pos, word: one row for each word of each text, in order."""
    source = strip_html(F.col(text)) if html else F.col(text)
    return docs.select(F.col(doc).alias("doc"), F.posexplode(split_words(source, shortest)).alias("pos", "word"))


def without_stop_words(words: DataFrame, stop: DataFrame | list[str]) -> DataFrame:
    """words not in the list; a list in a table is an anti-join, broadcast by Spark if it is short."""
    if isinstance(stop, list):
        return words.where(~F.col("word").isin(stop))
    return words.join(stop.select("word").distinct(), "word", "left_anti")


def histogram(words: DataFrame) -> DataFrame:
    """doc, word, n: term frequencies."""
    return words.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("n"))


def stem_histogram(hist: DataFrame) -> DataFrame:
    """doc, stem, n: term frequencies by stem."""
    return with_stems(hist).groupBy("doc", "stem").agg(F.sum("n").alias("n"))


def stem_groups(words: DataFrame) -> DataFrame:
    """stem, words: the different words that share each stem."""
    return with_stems(words.select("word").distinct()).groupBy("stem").agg(F.array_sort(F.collect_set("word")).alias("words"), F.count(F.lit(1)).alias("n_words"))


def document_frequency(hist: DataFrame, term: str = "word") -> DataFrame:
    """term, n_docs; a histogram has a row for each document and term, so counting rows is enough."""
    return hist.groupBy(term).agg(F.count(F.lit(1)).alias("n_docs"))


def tf_idf(hist: DataFrame, term: str = "word") -> DataFrame:
    """doc, term, weight = n log2(documents / documents with the term); documents are those with any term."""
    total = hist.agg(F.count_distinct("doc").alias("total"))
    return hist.join(document_frequency(hist, term), term).crossJoin(F.broadcast(total)).select("doc", term, (F.col("n") * F.log2(F.col("total") / F.col("n_docs"))).alias("weight"))


def normalised(weights: DataFrame, term: str = "word") -> DataFrame:
    """Weights divided by the length of their document's vector; documents of length zero have no row."""
    norm = weights.groupBy("doc").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).where("norm > 0")
    return weights.join(norm, "doc").select("doc", term, (F.col("weight") / F.col("norm")).alias("weight")).where("weight <> 0")


def cosine_pairs(weights: DataFrame, term: str = "word", least: float = 0.0) -> DataFrame:
    """doc_i < doc_j, cosine above ``least``, for documents that share a weighted term.

    The join is on the term.  Terms in all documents have weight 0 and take no
    part; very common terms make the join large, which AQE splits.
    """
    w = normalised(weights, term)
    a, b = w.select(term, F.col("doc").alias("doc_i"), F.col("weight").alias("wi")), w.select(term, F.col("doc").alias("doc_j"), F.col("weight").alias("wj"))
    return a.join(b, term).where("doc_i < doc_j").groupBy("doc_i", "doc_j").agg(F.sum(F.col("wi") * F.col("wj")).alias("cosine")).where(F.col("cosine") > least)


def inverted_index(words: DataFrame) -> DataFrame:
    """Distinct (word, doc)."""
    return words.select("word", "doc").distinct()
