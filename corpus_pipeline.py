"""The corpus pipeline: raw documents to packed training sequences.

quality -> language -> near_copies -> decontaminate -> pack. Each stage's result is written as Parquet and read again
as the next one's input; all stages but the last return rows of documents with their columns. Models are fitted on the
documents that a stage is given and on the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import decontam, langid, ngramjoin, packing, quality
from emberwatch.llm.common import staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without letters, or without a leading language, go."""
    return langid.keep_identified(docs, langid.fit_languages(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-grams, Jaccard 0.8): the one of the smallest doc_id. A row
    without doc_id stands for its text. Rows that repeat an id and text are one document."""
    number = F.coalesce(F.col("doc_id"), F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62))
    key = F.struct(number.alias("number"), F.xxhash64("text").alias("text"))  # rows of one id with other texts are other documents
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    groups = ngramjoin.linked_groups(rows.select(F.col("key").alias("doc_id"), "row.text"), n=5, percent=80)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    return rows.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece in the training sequences."""
    return packing.pack(packing.token_pieces(docs, with_ids=False))


STAGES = [("quality", good_quality), ("language", known_language), ("near_copies", near_copies),
          ("decontaminate", decontaminate), ("pack", pack)]

#: Model scores and tokenizers have no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
