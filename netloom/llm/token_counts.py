"""Token counts with a digest cache.

The cache is a table (tokenizer, digest, n_tokens): the digest of the tokenizer's file, so a new version shares nothing with an old one, and that of
the normalised content. A run joins the documents' digests to it, encodes each distinct text that is missing once, and appends what it found.
Counts must be the library's for the text as it is, so normalising is no more than null to empty.

The text moves once, with its digest; copies are dropped before and after that move, so that a text a third of all rows share is encoded once and
reaches a task once per partition. Repeated rows and ids are rows of their own, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.blocks import slices
from netloom.llm.memory import remembered, tidy
from netloom.llm.scratch import Scratch

LIMIT = 4096
#: The session's setting that names the cache of the registered query; unset, a run starts with an empty one.
CACHE_SETTING = "spark.netloom.tokenCache"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """A tokenizer that neither pads nor truncates and runs in the task's own thread; others' stacks and heaps would outlive it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    return model


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens; one tokenizer per worker process."""

    def load() -> Callable[[list[str]], list[int]]:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        model = load_tokenizer(path)
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]

    return remembered(("counter", path), load)


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of digest, text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_pydict({"digest": piece.column("digest"), "n_tokens": pa.array(np.array(count(piece.column("text").to_pylist()), np.int64))})

    return texts.select("digest", "text").mapInArrow(tidy(encode, remembers=True), "digest binary, n_tokens long")


def token_counts(spark: SparkSession, docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``cache``: the folder of the cache in a store all executors share; by default one of this run.
    A folder without a table yet, or with one of other tokenizers alone, is a cache without hits."""
    scratch = Scratch(spark, "tokens")
    cache = cache or f"{scratch.root}/cache"
    version = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    schema = "tokenizer string, digest binary, n_tokens long"
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    missing = base.select("digest", "text")
    if files.exists(folder):
        known = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version)
        missing = missing.join(known, "digest", "left_anti")
    found = encoded(missing.dropDuplicates(["digest"]), path).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    found.write.mode("append").parquet(cache)
    counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = scratch.keep(counts, "counts")  # a join of two tables is left, in which Spark can split a digest that many rows share
    rows = base.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"), spark.conf.get(CACHE_SETTING, None), limit=4096)
