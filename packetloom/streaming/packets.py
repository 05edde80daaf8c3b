"""Packets as a stream: flows per event-time window, and what follows from each finished or
updated window.

Windows are anchored at ``t0``. Packets go to the window of their own time, up to the watermark.
A window is cut into slices. State is one row of fixed width per flow and instant of an open slice, which the
watermark lets go of; so late packets still find their place in order, and no row grows with a flood. Rows leave in
update mode, so the last window needs no closing packet. The instants of a slice and the slices of a flow are put in time
order where a window is processed. Every micro-batch writes its rows into its own folder, and readers take the
newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.cleaning import epoch_seconds
from packetloom.functions.identity import stream_flow_id
from packetloom.operators.graph import graph_summaries
from packetloom.operators.scoring import window_scores
from packetloom.operators.search import top_flows_per_window
from packetloom.operators.similarity import feature_embeddings
from packetloom.operators.stats import severity_breakdown
from packetloom.schemas import ALERTS, PACKETS
from packetloom.sources.sinks import append, latest

FIVE_TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
ALERT_SCORE, TOP_SCORE, TOP_SIZE = 0.5, 0.7, 5  # fixed values
SLICES = 16  # parts of a window
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HEAP_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
STATE_STORE = {
    STATE_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",  # of an executor
}
INSTANT_VALUES = ["packet_count", "total_bytes", "payload", "label"]


def packet_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    raw = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", max_files).json(path)
    return with_event_time(raw)


def with_event_time(packets: DataFrame) -> DataFrame:
    seconds = epoch_seconds("timestamp")
    return packets.where("timestamp is not null").withColumns(
        {
            "timestamp": seconds,
            "event_time": F.timestamp_micros(F.round(seconds * F.lit(1e6)).cast("long")),
            "src_ip": F.coalesce("src_ip", F.lit("0.0.0.0")),
            "dst_ip": F.coalesce("dst_ip", F.lit("0.0.0.0")),
            "src_port": F.coalesce("src_port", F.lit(0)),
            "dst_port": F.coalesce("dst_port", F.lit(0)),
            "protocol": F.coalesce("protocol", F.lit(0)),
        }
    )


def _slice_length(size_us: int) -> int:
    """A window in up to SLICES equal parts of whole microseconds."""
    return size_us // next(n for n in range(SLICES, 0, -1) if size_us % n == 0)


def flow_instants(packets: DataFrame, size: float, t0: float = 0.0, watermark: str | None = "10 minutes") -> DataFrame:
    """One row per flow, slice of a window and distinct instant: counts and the label of the first packet. Every column has a
    fixed width, so rows are added up in generated code. Works on a stream and, with ``watermark=None``, on a table."""
    size_us, t0_us = round(size * 1e6), round(t0 * 1e6)
    slice_us = _slice_length(size_us)
    timed = packets.withWatermark("event_time", watermark) if watermark else packets
    cut = F.window("event_time", f"{slice_us} microseconds", startTime=f"{t0_us % slice_us} microseconds")
    start_us = F.unix_micros(F.col("window.start")) - F.lit(t0_us)
    window_id = F.floor(start_us / F.lit(size_us)).cast("long")
    return (
        timed.groupBy(cut, *FIVE_TUPLE, "timestamp")
        .agg(
            F.count("*").alias("packet_count"),
            F.sum(F.coalesce("packet_length", F.lit(0))).alias("total_bytes"),
            F.sum(F.coalesce("payload_length", F.lit(0))).alias("payload"),
            # of one instant, packets without an index come first
            F.min_by(F.coalesce("label", F.lit(0)), F.coalesce("packet_index", F.lit(-(2**63)))).alias("label"),
        )
        .select(
            window_id.alias("window_id"),
            ((window_id * F.lit(size_us) + F.lit(t0_us)) / F.lit(1e6)).alias("window_start"),
            F.floor((start_us % F.lit(size_us) + F.lit(size_us)) % F.lit(size_us) / F.lit(slice_us)).cast("int").alias("slice"),
            *FIVE_TUPLE,
            "timestamp",
            *INSTANT_VALUES,
        )
    )


def newest_instants(versions: DataFrame) -> DataFrame:
    """The newest row of each instant of a flow. Rows meet by flow and slice, where ``join_instants`` needs them."""
    placed = with_flow_hash(versions).repartition("_flow", "slice")
    return placed.groupBy("_flow", "window_id", "window_start", "slice", *FIVE_TUPLE, "timestamp").agg(
        *[F.max_by(c, "batch_id").alias(c) for c in INSTANT_VALUES]
    )


def with_flow_hash(instants: DataFrame) -> DataFrame:
    """The hash stands first among the keys of a flow, so that rows are sorted by one number."""
    return instants.withColumn("_flow", F.xxhash64("window_id", *FIVE_TUPLE))


def join_instants(instants: DataFrame) -> DataFrame:
    """Flow rows per (window, 5-tuple): packets, bytes, label of the first packet, mean payload, mean and deviation of the
    gaps between packets (the first packet's gap is 0). Instants are put in order within a slice, and then the slices
    of a flow, SLICES at most; so a flood is sorted in as many parts."""
    flow = ["_flow", "window_id", *FIVE_TUPLE]
    gap = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy(*flow, "slice").orderBy("timestamp")), F.lit(0.0))
    slices = (
        instants.withColumn("_gap", gap)
        .groupBy(*flow, "window_start", "slice")
        .agg(
            F.sum("packet_count").alias("packet_count"),
            F.sum("total_bytes").alias("total_bytes"),
            F.sum("payload").alias("payload"),
            F.min_by("label", "timestamp").alias("label"),
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
            F.sum(F.col("_gap") * F.col("_gap")).alias("gap2"),
        )
    )
    between = F.col("first") - F.lag("last").over(Window.partitionBy(*flow).orderBy("slice"))
    n = F.col("packet_count")
    joined = (
        slices.withColumn("_between", F.coalesce(between, F.lit(0.0)))
        .groupBy(*flow, "window_start")
        .agg(
            F.sum("packet_count").alias("packet_count"),
            F.sum("total_bytes").alias("total_bytes"),
            F.sum("payload").alias("_payload"),
            F.min_by("label", "slice").alias("label"),
            (F.max("last") - F.min("first")).alias("_length"),
            F.sum(F.col("gap2") + F.col("_between") * F.col("_between")).alias("_gap2"),
        )
        .withColumn("mean_iat", F.col("_length") / n)
    )
    variance = (F.col("_gap2") - n * F.col("mean_iat") * F.col("mean_iat")) / F.greatest(n - 1, F.lit(1))
    return joined.select(
        "window_id",
        "window_start",
        *FIVE_TUPLE,
        n,
        "total_bytes",
        (F.col("_payload") / n).alias("mean_payload"),
        "mean_iat",
        F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("std_iat"),
        "label",
        stream_flow_id().alias("flow_id"),
    )


def window_flows(packets: DataFrame, size: float, t0: float = 0.0) -> DataFrame:
    """The flows of a table of packets, as the stream makes them."""
    return join_instants(with_flow_hash(flow_instants(packets, size, t0, watermark=None)))


@dataclass
class StreamTables:
    """Folders of the tables a run writes."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, spark: SparkSession, name: str, schema: T.StructType, keys: list[str] | None = None) -> DataFrame:
        typed = T.StructType([f for f in schema.fields if f.name != "batch_id"]).add("batch_id", T.LongType())
        rows = spark.read.schema(typed).parquet(self.path(name))
        return latest(rows, keys, "batch_id") if keys else rows


RESULTS = T.StructType(
    [
        T.StructField("window_id", T.LongType()),
        T.StructField("window_start", T.DoubleType()),
        T.StructField("num_flows", T.LongType()),
        T.StructField("num_nodes", T.LongType()),
        T.StructField("num_embeddings", T.LongType()),
        T.StructField("anomaly_score", T.DoubleType()),
    ]
)
BREAKDOWN = T.StructType(
    [
        T.StructField("window_id", T.LongType()),
        T.StructField("breakdown", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)
TOP_FLOWS = T.StructType(
    [
        T.StructField("window_id", T.LongType()),
        T.StructField("flow_id", T.StringType()),
        T.StructField("prediction_score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
)


def window_processor(
    spark: SparkSession,
    tables: StreamTables,
    instant_schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    alert_score: float = ALERT_SCORE,
    embed: Callable[[DataFrame], DataFrame] = feature_embeddings,
) -> Callable[[DataFrame, int], None]:
    """What happens after each micro-batch, for the windows it touched. Which windows meet in a batch is chance, so
    ``score`` and ``embed`` should bring fitted scales along (``Scaling``)."""

    def process(batch: DataFrame, batch_id: int) -> None:
        append(batch, tables.path("instants"), batch_id)
        fresh = spark.read.schema(instant_schema).parquet(f"{tables.path('instants')}/batch_id={batch_id}")
        if fresh.isEmpty():
            return
        touched = fresh.select("window_id").distinct()
        oldest = fresh.agg(F.min("window_id")).first()[0]
        # only rows of windows touched now; files with older windows are skipped by their statistics
        typed = T.StructType([*instant_schema.fields, T.StructField("batch_id", T.LongType())])
        versions = spark.read.schema(typed).parquet(tables.path("instants")).where(F.col("window_id") >= oldest)
        flows = join_instants(newest_instants(versions.join(touched, "window_id", "left_semi")))
        append(flows, tables.path("flows"), batch_id)
        flows = spark.read.schema(flows.schema).parquet(f"{tables.path('flows')}/batch_id={batch_id}")
        scores = score(flows).select("flow_id", "window_id", "prediction_score", "prediction")
        append(scores, tables.path("scores"), batch_id)
        scores = spark.read.schema(scores.schema).parquet(f"{tables.path('scores')}/batch_id={batch_id}")
        embeddings = embed(flows)
        append(embeddings, tables.path("embeddings"), batch_id)
        start = flows.groupBy("window_id").agg(F.min("window_start").alias("window_start"), F.count("*").alias("num_embeddings"))
        results = (
            graph_summaries(flows)
            .select("window_id", "num_nodes")
            .join(start, "window_id")
            .join(window_scores(scores), "window_id")
            .select(*RESULTS.names)
        )
        append(results, tables.path("results"), batch_id)
        results = spark.read.schema(RESULTS).parquet(f"{tables.path('results')}/batch_id={batch_id}")
        # a window below the limit now may have had an alert before: its row withdraws it
        alerts = results.withColumn("active", F.col("anomaly_score") >= alert_score)
        append(alerts.select(*[c for c in ALERTS.names if c != "batch_id"]), tables.path("alerts"), batch_id)
        # counts per touched window; cumulative_breakdown adds up the newest of every window
        with_scores = flows.join(scores.drop("window_id"), "flow_id", "left")
        append(severity_breakdown(with_scores, ["window_id"]), tables.path("breakdown"), batch_id)
        top = top_flows_per_window(with_scores, TOP_SCORE, TOP_SIZE)
        append(top.select(*TOP_FLOWS.names), tables.path("top_flows"), batch_id)

    return process


def run_available(
    spark: SparkSession,
    packets: DataFrame,
    tables: StreamTables,
    score: Callable[[DataFrame], DataFrame],
    size: float,
    t0: float = 0.0,
    watermark: str = "10 minutes",
    alert_score: float = ALERT_SCORE,
    embed: Callable[[DataFrame], DataFrame] = feature_embeddings,
) -> StreamTables:
    """Takes in all files there are, then stops; started again, it goes on where it stopped. Unless the session names another
    state store, state lies in RocksDB, on disk and in bounded memory, and not on the heap."""
    instants = flow_instants(packets, size, t0, watermark)
    own = {k: v for k, v in STATE_STORE.items() if spark.conf.get(STATE_PROVIDER, HEAP_STORE) == HEAP_STORE}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:  # a query takes the settings of the session along when it starts
        query = (
            instants.writeStream.outputMode("update")
            .option("checkpointLocation", tables.path("_progress"))
            .trigger(availableNow=True)
            .foreachBatch(window_processor(spark, tables, instants.schema, score, alert_score, embed))
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return tables


def last_touched(spark: SparkSession, tables: StreamTables) -> DataFrame:
    """(window_id, batch_id): the last batch that touched each window. It wrote all rows of the window anew."""
    return tables.read(spark, "results", RESULTS).groupBy("window_id").agg(F.max("batch_id").alias("batch_id"))


def newest_per_window(spark: SparkSession, tables: StreamTables, name: str, schema: T.StructType) -> DataFrame:
    """Rows of a table written by the last batch that touched their window. One row per window meets the table, so its rows
    are neither sorted nor compared with each other."""
    return tables.read(spark, name, schema).join(last_touched(spark, tables), ["window_id", "batch_id"])


def cumulative_breakdown(spark: SparkSession, tables: StreamTables) -> DataFrame:
    """Severity and volume counts over all flows so far, from the newest counts of each window."""
    rows = newest_per_window(spark, tables, "breakdown", BREAKDOWN)
    return rows.groupBy("breakdown", "category").agg(F.sum("n").alias("n"))


def active_alerts(spark: SparkSession, tables: StreamTables) -> DataFrame:
    """Windows whose newest row in the alert table is an alert; an alert withdrawn by later packets is not among them."""
    return tables.read(spark, "alerts", ALERTS, ["window_id"]).where("active").drop("active")


def run_kpis(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("windows"),
        F.coalesce(F.sum("num_flows"), F.lit(0)).alias("total_flows"),
        F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.max("anomaly_score"), F.lit(0.0)).alias("max_score"),
    )
