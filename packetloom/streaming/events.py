"""Event streams beside the window job: labels that arrive on their own, bursts of a source, overlapping windows, and the
progress of a run as rows."""

from __future__ import annotations

import threading
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from packetloom.operators.flows import FLOW_KEY

LABEL_EVENTS = T.StructType(
    [T.StructField("packet_index", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("label_time", T.DoubleType())]
)


def label_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    raw = spark.readStream.schema(LABEL_EVENTS).option("maxFilesPerTrigger", max_files).json(path)
    return with_label_time(raw)


def with_label_time(labels: DataFrame) -> DataFrame:
    """The time of a label as a timestamp; a label without a number or a time labels nothing."""
    return labels.where("packet_index is not null and label_time is not null").withColumn(
        "label_time", F.timestamp_micros(F.round(F.col("label_time") * F.lit(1e6)).cast("long"))
    )


def join_labels(packets: DataFrame, labels: DataFrame, within: str, watermark: str | None = "10 minutes") -> DataFrame:
    """Packets (packet_index, event_time, ...) with the label that comes up to ``within`` after them, and 0 where none does.

    On two streams both sides wait for each other up to the watermark: a packet leaves with its label at once, or with 0
    when no label can come any more. State holds the rows of one time bound and forgets them as the watermark moves.
    With ``watermark=None`` the sides are tables.
    """
    right = labels.select(F.col("packet_index").alias("_labelled"), F.col("label").alias("_label"), "label_time")
    if watermark:
        packets, right = packets.withWatermark("event_time", watermark), right.withWatermark("label_time", watermark)
    bound = F.expr(f"label_time >= event_time and label_time <= event_time + interval {within}")
    joined = packets.drop("label").join(right, (F.col("packet_index") == F.col("_labelled")) & bound, "left_outer")
    return joined.withColumn("label", F.coalesce("_label", F.lit(0))).drop("_labelled", "_label", "label_time")


def bursts(packets: DataFrame, gap: str, watermark: str | None = "10 minutes") -> DataFrame:
    """Sessions of a source: its packets, each less than ``gap`` after the one before. One row per session with start, last packet,
    number of packets and bytes. On a stream a session leaves once the watermark has passed its end."""
    timed = packets.withWatermark("event_time", watermark) if watermark else packets
    return (
        timed.groupBy(F.session_window("event_time", gap), "src_ip")
        .agg(
            F.count("*").alias("packets"),
            F.sum(F.coalesce("packet_length", F.lit(0))).alias("total_bytes"),
            F.min("timestamp").alias("started"),
            F.max("timestamp").alias("ended"),
        )
        .drop("session_window")
    )


def sliding_counts(packets: DataFrame, size: float, stride: float, t0: float = 0.0, watermark: str | None = "10 minutes") -> DataFrame:
    """Flows of overlapping windows from ``t0`` on: packets, bytes and the worst label per (window, flow).

    Two stateful steps. Packets are added up in panes that do not overlap, and finished panes go to the windows that hold
    them, so the overlap multiplies panes and never packets. On a stream a window leaves once the watermark has passed its end.
    Windows before ``t0`` have negative numbers.
    """
    size_us, stride_us, t0_us = (round(x * 1e6) for x in (size, stride, t0))
    pane_us = gcd(size_us, stride_us)
    timed = packets.withWatermark("event_time", watermark) if watermark else packets
    pane = F.window("event_time", f"{pane_us} microseconds", startTime=f"{t0_us % pane_us} microseconds").alias("pane")
    panes = timed.groupBy(pane, *FLOW_KEY).agg(
        F.count("*").alias("packet_count"), F.sum(F.coalesce("packet_length", F.lit(0))).alias("total_bytes"), F.max(F.coalesce("label", F.lit(0))).alias("label")
    )
    window = F.window(
        F.window_time("pane"), f"{size_us} microseconds", f"{stride_us} microseconds", f"{t0_us % stride_us} microseconds"
    )
    windows = panes.groupBy(window, *FLOW_KEY).agg(
        F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("total_bytes"), F.max("label").alias("label")
    )
    window_id = F.floor((F.unix_micros(F.col("window.start")) - F.lit(t0_us)) / F.lit(stride_us)).cast("long")
    return windows.select(window_id.alias("window_id"), *FLOW_KEY, "packet_count", "total_bytes", "label")


def run_to_end(rows: DataFrame, out: str, progress: str) -> StreamingQuery:
    """Appends what a stream yields from the files there are; started again, it goes on where it stopped. Returns the
    finished query, whose ``recentProgress`` tells what its state held."""
    query = rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True)
    started = query.start()
    started.awaitTermination()
    return started


PROGRESS = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("started", T.StringType()),
        T.StructField("input_rows", T.LongType()),
        T.StructField("observed_rows", T.LongType()),
        T.StructField("without_address", T.LongType()),
        T.StructField("late_groups", T.LongType()),
        T.StructField("state_rows", T.LongType()),
        T.StructField("watermark", T.StringType()),
        T.StructField("milliseconds", T.LongType()),
    ]
)


def observed(packets: DataFrame) -> DataFrame:
    """Counts the packets of each micro-batch as they pass, without a pass of its own."""
    missing = F.col("src_ip").isNull() | F.col("dst_ip").isNull()
    return packets.observe("packets", F.count("*").alias("rows"), F.count_if(missing).alias("without_address"))


class ProgressLog(StreamingQueryListener):
    """Writes one row per micro-batch under ``path``: what came in, what came too late (after packets of one flow and slice have been
    put together), what the state holds and how long it took. Attach it with ``with log:`` around a run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended = threading.Event()

    def __enter__(self) -> "ProgressLog":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._ended.wait(60)  # events come in order, so nothing of the run is missing after its last one
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self._ended.clear()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("packets")
        row = (
            p.batchId,
            p.timestamp,
            p.numInputRows,
            seen["rows"] if seen else None,
            seen["without_address"] if seen else None,
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            sum(s.numRowsTotal for s in p.stateOperators),
            (p.eventTime or {}).get("watermark"),
            p.batchDuration,
        )
        # a batch that is repeated after a failure replaces its row
        rows = self.spark.createDataFrame([row], PROGRESS).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={p.batchId}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).parquet(f"{self.path}/*")
