"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeledger.llm import (
    bpe, chat, decontaminate, extract, jaccard, language, negatives, periodic, quality, secrets, substring, toxicity, urls,
)
from lifeledger.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.weights(docs, table(spark, sf_dir, "labels").where("quality = 1")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents"))
    return secrets.report(secrets.found(scanned, secrets.cutoffs(scanned)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.repeats(table(spark, sf_dir, "documents")))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.digests(periodic.periodic_runs(docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_jaccard": op8_jaccard,
    "op9_urls": op9_urls,
    "op10_extract": op10_extract,
    "op11_substring": op11_substring,
    "op12_negatives": op12_negatives,
    "op13_periodic": op13_periodic,
}

ORACLES: dict[str, str] = {
    "op1_chat": chat.SQL, "op9_urls": urls.sql(), "op11_substring": substring.SQL, "op12_negatives": negatives.SQL, "op13_periodic": periodic.SQL,
}
