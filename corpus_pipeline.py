"""From raw documents to token ids: five stages, each one operator of lodestrata.llm.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and is written as Parquet and read again before the next.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, language, lines, pieces, similar
from lodestrata.llm.base import beside, read, release, store, unveiled, veiled
from lodestrata.llm.queries import VOCABULARY

#: No SQL: naive Bayes, near copies and the piece vocabulary have none in DuckDB.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts, texts without letters, and
    those whose likeliest language has a posterior below one half.  lang becomes
    the predicted language of those that stay."""
    model = language.train(docs.where(~language.held_out()).select("lang", "text"))
    plain, names = veiled(docs)
    found = language.identify(plain, model, names["text"]).where("lang_pred <> 'und' and score >= 0.5")
    return unveiled(found.withColumn(names["lang"], F.col("lang_pred").cast(docs.schema["lang"].dataType)), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs of 50 words or more; documents left without a word go.

    n_chars follows the text where lines went.
    """
    plain, names = veiled(docs)
    text, n_chars = names["text"], names.get("n_chars")
    out = lines.dedup_lines(plain, 50, names["doc_id"], text)
    changed = F.col("n_deleted") > 0
    out = out.where(~(changed & (F.trim(F.col(text)) == "")))
    if n_chars:
        out = out.withColumn(n_chars, F.when(changed, F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema["n_chars"].dataType))
    return unveiled(out, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of near copies.

    Near copies have SimHash fingerprints (of 5-word shingles) within 14 of 64
    bits and a Jaccard similarity of their shingles of 0.8 or more.  Of rows
    with equal id and text one stays.  Different texts with one id stay if one
    of them does, and documents without id stay, equal texts once."""
    plain, names = veiled(docs)
    doc_id, text = names["doc_id"], names["text"]
    named = similar.near_copies(plain, doc_id, text, words=5, radius=14, least=0.8)
    named = store(named.groupBy(F.col(doc_id).alias("id")).agg(F.max("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "near-named")
    same = F.col(doc_id).eqNullSafe(F.col("id"))
    kept = plain.join(beside(named.where("id <> component_id").select("id")), same, "left_anti")
    repeated = named.where("n > 1").select("id")
    if not repeated.isEmpty():
        once = kept.join(beside(repeated), same, "left_anti")
        kept = once.union(kept.join(beside(repeated), same, "left_semi").dropDuplicates([doc_id, text]))
    return unveiled(kept, names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an 8-word window of any benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), least_items=1)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_ids, and whether decoding the ids gives the text back."""
    return pieces.encode_and_check(docs.select("doc_id", "lang", "source", "text"), pieces.Vocabulary.load(VOCABULARY)).drop("ids_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenise", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
