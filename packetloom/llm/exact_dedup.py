"""Exact duplicates by sorting the content.

Normalised texts are range-partitioned with sampled splitters and sorted externally, so equal texts lie
next to each other; the window over the sorted rows compares neighbours in full. The splitters use a
prefix of bounded length, a hash and a salt, which only route rows: what reaches the driver as a sample
does not grow with the texts, and a group of copies that holds much of the table is dealt over several
partitions. Each partition then reports one row per text and salt, and those few rows settle the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import keep_rows, text_key
from packetloom.store import Store

SPACES = " \t\n\x0b\x0c\r"
ROUTE_CHARS = 32


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def group_copies(docs: DataFrame, store: Store) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 and _key (the text's hash).

    Of texts equal up to ASCII white space, the longest original stays, then the smallest doc_id; a
    null doc_id comes last. Of rows that repeat entirely, exactly one is kept. Null is the empty
    text. Other columns of `docs` are not read.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    norm = normalised(F.col("text"))
    rows = (
        docs.select(
            "doc_id",
            text_key().alias("_key"),
            F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("_points"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_salt"),
            norm.alias("_norm"),
        )
        .select("*", F.substring("_norm", 1, ROUTE_CHARS).alias("_head"), F.xxhash64("_norm").alias("_hash"))
        .repartitionByRange("_head", "_hash", "_salt")
    )
    order = [F.col("_points").desc(), F.col("doc_id").asc_nulls_last(), F.col("_key")]
    equal = Window.partitionBy("_head", "_hash", "_salt", "_norm")
    sorted_rows = rows.select(
        "doc_id",
        "_key",
        "_points",
        "_salt",
        F.row_number().over(equal.orderBy(*order)).alias("_rank"),
        F.count(F.lit(1)).over(equal).alias("_rows"),
        F.sha2("_norm", 256).alias("text_sha256"),
    )
    sorted_rows = store.save(sorted_rows, "content-sorted")

    group = Window.partitionBy("text_sha256")
    best = group.orderBy(*order)
    heads = sorted_rows.where("_rank = 1").select(
        F.col("text_sha256").alias("_sha"),
        F.col("_salt").alias("_part"),
        F.first("doc_id").over(best).alias("keep_id"),
        F.first("_salt").over(best).alias("_keep_salt"),
        F.sum("_rows").over(group).alias("group_size"),
    )
    return sorted_rows.join(
        heads, (sorted_rows["text_sha256"] == heads["_sha"]) & (sorted_rows["_salt"] == heads["_part"])
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("_rank") == 1) & (F.col("_salt") == F.col("_keep_salt"))).alias("kept"),
        "text_sha256",
        "_key",
    )


def drop_copies(docs: DataFrame, store: Store) -> DataFrame:
    """`docs` with one row per group of equal texts, all columns as they were."""
    return keep_rows(docs, group_copies(docs, store).where("kept"))
