"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the
last return the columns of ``documents``. Between stages the rows are written as Parquet to the shared
folder and read back, so a lost executor costs a stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeledger.llm import bpe, decontaminate, jaccard, quality, secrets
from lifeledger.llm.common import bounded, stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids``; columns in their order."""
    return docs.join(bounded(ids.distinct()), "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble trusted ones."""
    model = quality.weights(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one: that with the smallest id, or any if ids repeat."""
    if not jaccard.ids_repeat(docs):
        found = stored(jaccard.classes(docs), "components")
        return _without(docs, found.where("component_id != doc_id").select("doc_id"))
    # Rows that share an id are told apart by their text; rows that share both are one document.
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), "text")
    found = stored(jaccard.classes(keyed, "key"), "components")
    gone = found.where("component_id != key").select("key").distinct()
    kept = keyed.where("key IS NOT NULL").join(bounded(gone), "key", "left_anti").dropDuplicates(["key"])
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = stored(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"), "leaks")
    return _without(docs, found)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; ``n_chars`` follows the new text."""
    scanned = secrets.scan(docs, keep=docs.columns)
    rows = secrets.found(scanned, secrets.cutoffs(scanned)).withColumn("clean", secrets.redacted("text", "spans"))
    changed = {
        "text": F.when(F.size("spans") > 0, F.col("clean")).otherwise(F.col("row.text")),
        "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and the tokens of every document."""
    encoded = bpe.encode(docs, TOKENIZER)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", tokens),
]

#: Hash buckets, components and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
