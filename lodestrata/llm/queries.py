"""The queries over the standard tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, pieces, pivots, secrets, urls
from .base import read
from .lines import dedup_lines
from .oracles import ORACLES as ORACLES
from .sharding import shard
from .simhash import near_duplicates
from .surrogates import pseudonymise


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.9)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates of the standard tables")


#: A public vocabulary file; a parameter of the encoder.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.train(urls.labelled(spark))).drop("url")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.train(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.summary(decontaminate.find_hits(docs, read(spark, sf_dir, "benchmark"), window=8), least_items=2).drop("text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(read(spark, sf_dir, "documents"), pieces.Vocabulary.load(VOCABULARY))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, radius=2)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.summary(secrets.scan(docs, secrets.train(secrets.labelled(spark)))).drop("text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), shards=24)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivots": op1_pivots,
    "op2_surrogates": op2_surrogates,
    "op3_urls": op3_urls,
    "op4_language": op4_language,
    "op5_lines": op5_lines,
    "op6_decontaminate": op6_decontaminate,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
}
