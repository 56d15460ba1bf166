"""A corpus from raw documents to packed bins, in five stages.

Each stage works on all that its predecessor kept and writes its result before
the next one reads it: documents of poor quality go, lines found in ten
documents or more go, one document of each group of near duplicates stays,
personal data becomes surrogates, and what is left is packed into bins.  All
but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.llm import jaccard, line_dedup, packing, pii, quality
from rowgraph.runtime import ensure_checkpoint_dir


def _with_text(docs: DataFrame, made: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``made``, with ``text`` as the text and its length, if there is one, after it."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return made.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, labels)


def without_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = ("_line_dedup_text", "_line_dedup_n", "_line_dedup_gone")
    return _with_text(docs, line_dedup.drop_frequent_lines(docs, names=names), names[0])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, pii.replace_entities(docs, pii.key_of(spark)), "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.count_tokens(F.col("text")))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_frequent_lines),
    ("ngram_jaccard_join", without_near_duplicates),
    ("pii_surrogates", with_surrogates),
    ("best_fit_packing", packed),
]

#: SQL cannot express the stages; the tests hold each against what was planted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
