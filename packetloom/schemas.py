"""Table schemas. Files are always read with one of these, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FEATURES = ["packet_count", "total_bytes", "mean_payload", "mean_iat", "std_iat"]
NODE_FEATURES = ["bytes_sent", "bytes_recv", "pkts_sent", "pkts_recv", "out_degree", "in_degree"]

PACKETS = T.StructType(
    [
        T.StructField("packet_index", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("inter_arrival_time", T.DoubleType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("ip_header_len", T.IntegerType()),
        T.StructField("tcp_flags", T.DoubleType()),
        T.StructField("udp_length", T.DoubleType()),
        T.StructField("payload_length", T.IntegerType()),
        T.StructField("packet_length", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
    ]
)

# The label file's two columns carry the names below on disk.
LABEL_FILE = T.StructType(
    [T.StructField("Unnamed: 0", T.LongType()), T.StructField("x", T.IntegerType())]
)

ALERTS = T.StructType(
    [
        T.StructField("window_id", T.LongType()),
        T.StructField("window_start", T.DoubleType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("num_flows", T.LongType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required column(s): {', '.join(missing)}")
    return df
