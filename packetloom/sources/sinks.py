"""Keyed tables: last write wins, partitioned output, retention and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400.0
KEEP_DAYS, COMPACT_AFTER_DAYS = 90, 7  # fixed values: retention in days
WINDOWS_PER_BUCKET = 1024


def latest(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key. An aggregate, not a window: copies of a hot key are combined
    before the shuffle."""
    rest = [c for c in versions.columns if c not in keys]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return newest.select(*keys, "_row.*")


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Existing rows with the updates put over them; only the keys of the updates are compared. Of
    updates that share a key the one of the highest ``version`` counts."""
    updates = latest(updates, keys, version)
    untouched = existing.join(updates.select(*keys), keys, "left_anti")
    return untouched.unionByName(updates, allowMissingColumns=True)


def write_by_window(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Partitioned by ranges of windows. The range shuffle on more than the window spreads a hot
    window over several tasks and files."""
    bucketed = df.withColumn("window_bucket", F.floor(F.col("window_id") / WINDOWS_PER_BUCKET).cast("int"))
    order = [c for c in ("window_id", "src_ip", "dst_ip", "ip", "flow_id") if c in df.columns]
    (
        bucketed.repartitionByRange("window_bucket", *order)
        .sortWithinPartitions("window_bucket", *order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_bucket")
        .parquet(path)
    )
    return path


def retained(df: DataFrame, now: float | None = None, keep_days: float = KEEP_DAYS, ts: str = "window_start") -> DataFrame:
    """Rows not older than ``keep_days``; now defaults to the newest row."""
    newest = F.lit(float(now)) if now is not None else df.agg(F.max(ts)).scalar()
    return df.where(F.col(ts) >= newest - F.lit(keep_days * DAY))


def write_by_day(df: DataFrame, path: str, ts: str = "window_start") -> str:
    dated = df.withColumn("day", F.floor(F.col(ts) / DAY).cast("long"))
    dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return path


def drop_expired(spark: SparkSession, path: str, newest_day: int, keep_days: int = KEEP_DAYS) -> list[int]:
    """Deletes the day folders of a table from write_by_day that are more than ``keep_days`` older than
    ``newest_day``; returns the days that went. Only folder names are looked at."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and int(name[4:]) < newest_day - keep_days:
            system.delete(status.getPath(), True)
            gone.append(int(name[4:]))
    return sorted(gone)


def compacted(
    df: DataFrame, path: str, now: float | None = None, after_days: float = COMPACT_AFTER_DAYS, ts: str = "window_start"
) -> DataFrame:
    """Days older than ``after_days`` are rewritten as few files each; a very large day is still split.
    Younger days keep their layout."""
    newest = F.lit(float(now)) if now is not None else df.agg(F.max(ts)).scalar()
    dated = df.withColumn("day", F.floor(F.col(ts) / DAY).cast("long"))
    old = dated.where(F.col(ts) < newest - F.lit(after_days * DAY))
    old.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    young = dated.where(F.col(ts) >= newest - F.lit(after_days * DAY))
    written = df.sparkSession.read.schema(dated.schema).parquet(path)
    return written.unionByName(young)


def append(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch, overwritten when the batch is retried: each batch counts once."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
