"""Order-dependent operators that never put one whole group, or the whole table, in one task.

A plain ``row_number().over(partitionBy(g).orderBy(k))`` sorts a group inside a single task, so
a group with a third of all rows decides the run time. Here the rows are range-partitioned on
(group, order key) instead, which balances on the rows themselves, and positions are put
together from per-partition counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.store import Store

_ROW_BITS = 33  # layout of monotonically_increasing_id: partition id above, row position below


def _sorted_once(df: DataFrame, order: list[Column | str], store: Store, name: str) -> DataFrame:
    """Range-partition, sort and number the rows; written, so every reader sees one layout."""
    laid_out = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    saved = store.save(laid_out, name)
    return (
        saved.withColumn("_part", F.shiftrightunsigned("_mid", _ROW_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_mid")
    )


def rank_within(
    df: DataFrame, group: list[str], order: list[str], store: Store, out: str = "row_idx"
) -> DataFrame:
    """0-based position of each row inside its group; ``group + order`` must be unique."""
    rows = _sorted_once(df, [*group, *order], store, f"ranked_{out}")
    # one row per (group, file partition): at most groups + partitions rows
    pieces = rows.groupBy(*group, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        rows.join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_before") + F.col("_pos") - F.col("_first"))
        .drop("_part", "_pos", "_first", "_before")
    )


def running_total(
    df: DataFrame, group: list[str], order: list[str], weight: str, store: Store, out: str
) -> DataFrame:
    """Inclusive running sum of ``weight`` inside each group, in ``order``."""
    rows = _sorted_once(df, [*group, *order], store, f"running_{out}")
    pieces = rows.groupBy(*group, "_part").agg(F.sum(weight).alias("_n"))
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_part").orderBy("_pos")
    return (
        rows.join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_before") + F.sum(weight).over(inside))
        .drop("_part", "_pos", "_before")
    )


def previous_value(
    df: DataFrame, order: list[str], value: str, store: Store, out: str
) -> DataFrame:
    """``lag(value)`` over the whole table: lag inside each range, last value of the range before it
    at its edge. The edge table has one row per range."""
    rows = _sorted_once(df, list(order), store, f"lagged_{out}")
    edges = rows.groupBy("_part").agg(F.max_by(value, "_pos").alias("_edge"))
    edges = edges.withColumn("_edge", F.lag("_edge").over(Window.orderBy("_part")))
    inside = Window.partitionBy("_part").orderBy("_pos")
    return (
        rows.join(edges, "_part")
        .withColumn(
            out, F.when(F.col("_pos") == 0, F.col("_edge")).otherwise(F.lag(value).over(inside))
        )
        .drop("_part", "_pos", "_edge")
    )


def rank_integers(
    df: DataFrame, key: str, out: str, group: list[str] | None = None, bucket: int = 4096
) -> DataFrame:
    """0-based rank of integer keys, unique within ``group``, without sorting a group as a whole:
    keys of one bucket are ranked together (at most ``bucket`` rows) and shifted by the sizes of the
    earlier buckets."""
    group = group or []
    cut = df.withColumn("_bucket", F.floor(F.col(key) / F.lit(bucket)))
    sizes = cut.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_bucket").orderBy(key)
    return (
        cut.join(sizes, [*group, "_bucket"])
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_before"))
        .drop("_bucket", "_before")
    )
