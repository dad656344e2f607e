"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one. All but the last
return the columns of documents; a stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm.decontamination import without_leaks
from netloom.llm.language_id import fit, recognised
from netloom.llm.ngram_join import keep_one
from netloom.llm.packing import pack_documents
from netloom.llm.scratch import Scratch
from netloom.llm.secret_scan import redacted
from netloom.llm.token_counts import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null and empty texts and those without a letter go, and those that the model rejects. Where no row
    is labelled nothing can be learned and nothing else goes. Nulls in other columns, repeated rows and further columns stay as they are, an
    empty table gives an empty one; texts are read whole."""
    return recognised(docs, fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Documents without words (null, empty) have no copies and
    stay; a null id comes last, and of equal ids the row that was written first is kept. Repeated rows are copies of each other. Further columns
    stay as they are, an empty table gives an empty one."""
    return keep_one(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak nothing and stay, repeated rows are judged alike, further columns stay as
    they are; an empty table or an empty benchmark changes nothing."""
    return without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what looks like a live secret is overwritten in their texts, character by character, with ``*``. Widely copied
    examples stay. Null texts stay null, repeated rows are rows of their own (and count as repositories of their value only once for each id),
    further columns stay as they are, an empty table gives an empty one."""
    return redacted(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048. Null and empty texts are the end id alone, a null id is a document, repeated rows are
    documents of their own, further columns go, an empty table gives an empty one; a text longer than a sequence fills whole ones first."""
    return pack_documents(spark, docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminated", decontaminated), ("without_secrets", without_secrets), ("packed", packed)]

#: Learning, tokenising and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
