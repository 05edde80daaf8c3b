"""From raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import bpe_replay, decontaminate, exact_dedup, langid, simhash
from packetloom.llm.common import bound_batches, table
from packetloom.llm.queries import tokenizer_path
from packetloom.store import Store

#: Of the last stage, whose workers live on beside what executors keep of the stages before it.
BLOCK_BYTES, CACHED_WORDS = 3_000_000, 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: what has no letter, and what no known language holds about as well as its own texts."""
    bound_batches(spark)
    filters = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), Store(spark))
    return langid.keep_identified(docs, filters)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: every copy but one of a text."""
    return exact_dedup.drop_copies(docs, Store(spark))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: every document but the first of a group of linked fingerprints."""
    bound_batches(spark)
    return simhash.drop_near_copies(docs, Store(spark))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: what shares a template window with a benchmark item."""
    bound_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), Store(spark))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text, of all that is left."""
    import public_tokenizers

    bound_batches(spark)
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return bpe_replay.encode_documents(
        docs, path, public_tokenizers.PATTERN, block_bytes=BLOCK_BYTES, cached_words=CACHED_WORDS
    )


STAGES = [
    ("language_id", language),
    ("exact_dedup", copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("bpe_encoding", token_ids),
]

#: No SQL twin: language filters, fingerprint components and byte-pair merges are not SQL; a test has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    store = Store(spark)
    for name, stage in STAGES:
        docs = store.save(stage(spark, docs, sf_dir), name)
    return docs
