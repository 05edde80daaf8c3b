"""Views that give the driver's tables the shapes of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.cleaning import timestamp_to_seconds

# Fixed values of the views: window size and stride in seconds.
WINDOW_SIZE = 21600.0
WINDOW_STRIDE = 10800.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: users are sources, the number in ``props`` picks the destination."""
    events = table(spark, sf_dir, "events")
    udp = F.col("event_type").isin("signup", "error")
    size = F.floor("value").cast("int")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("packet_index"),
        timestamp_to_seconds("ts").alias("timestamp"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 6).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.0."), (k % 9).cast("string")).alias("dst_ip"),
        (F.lit(1024) + F.col("event_id") % 50000).cast("int").alias("src_port"),
        F.when(udp, 1900).otherwise(80).alias("dst_port"),
        F.when(udp, 17).otherwise(6).alias("protocol"),
        F.when(udp, size + 8).cast("double").alias("udp_length"),
        F.when(udp, F.lit(0.0)).otherwise((F.col("event_id") % 32).cast("double")).alias("tcp_flags"),
        size.alias("payload_length"),
        (size + 42).alias("packet_length"),
        F.when(F.col("value") > 100, 1).otherwise(0).alias("label"),
    )


def dirty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with NaN, infinities and nulls planted by line number."""
    line = F.col("l_linenumber")
    quantity = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(line == 1, F.lit(float("nan")))
        .when(line == 2, F.lit(float("inf")))
        .when(line == 3, F.lit(float("-inf")))
        .when(line == 4, F.lit(None))
        .otherwise(quantity)
        .alias("packet_count"),
        F.when(line == 5, F.lit(float("nan"))).otherwise(F.col("l_extendedprice").cast("double")).alias("total_bytes"),
        (line - 3).cast("int").alias("label"),
    )


def with_test_scores(flows: DataFrame) -> DataFrame:
    """Deterministic scores; one flow in seven has none."""
    score = ((F.col("window_id") * 31 + F.col("edge_idx") * 17) % 101) / F.lit(100.0)
    score = F.when(F.col("edge_idx") % 7 == 0, F.lit(None)).otherwise(score)
    return flows.withColumn("prediction_score", score).withColumn(
        "prediction", (F.col("prediction_score") >= 0.5).cast("int")
    )


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges from supplier to customer, one window per month of shipment."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        month.cast("long").alias("window_id"),
        month.cast("double").alias("window_start"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_ip"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst_ip"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_idx"),
        F.col("l_quantity").cast("long").alias("packet_count"),
        F.floor("l_extendedprice").cast("long").alias("total_bytes"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )
