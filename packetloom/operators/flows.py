"""Packets to flows.

A flow is one (window, source, destination, protocol[, port]) with packet count, bytes, mean
payload, mean and deviation of the gaps between packets, and the worst label. The gap needs
packets in time order, which would tie a flood on one pair of hosts to one task. So a flow is cut
into narrow slices of time, and each step works on bounded groups:

1. packets meet in their slice, combined map-side: sums, and the distinct instants (packets of one instant have
   no gap). Packets are read and shuffled once. A slice is inside a fixed set of overlapping windows, so packets
   are never multiplied by the overlap;
2. where windows overlap many times, neighbouring slices are joined up before they are multiplied;
3. slices go out to the windows that contain them and are joined up in time order, adding the
   gaps between neighbouring slices. A flow has at most size / stride * splits slices per window.

Packets are spread by flow and slice, so a flood is as many groups as it has slices, and a quiet flow has no more
slices than packets. Slices have a fixed length: nothing is counted beforehand to choose it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.identity import flow_id
from packetloom.operators.ordered import previous_value, rank_within
from packetloom.operators.windows import SlidingWindows, sliding_span, time_bounds, tumbling_window
from packetloom.schemas import require_columns
from packetloom.store import Store

PAIR = ["src_ip", "dst_ip", "protocol"]
FLOW_KEY = [*PAIR, "dst_port"]
SPLITS = 1024  # slices per stride
COARSE = 64  # slices joined up in step 2
PORT_SKETCH = 12  # 2**12 registers: a standard error of 1.6 %
MANY_WINDOWS = 4  # windows over one packet from which step 2 is worth its shuffle


def merge_labels(packets: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on packet_index; packets without a label are normal."""
    return packets.join(labels.select("packet_index", "label"), "packet_index", "left").na.fill(
        0, ["label"]
    )


def prepare_packets(packets: DataFrame) -> DataFrame:
    """Checks columns, drops rows without endpoints or protocol, settles port and protocol."""
    require_columns(
        packets,
        ["timestamp", *FLOW_KEY, "payload_length", "packet_length", "label"],
    )
    # plain null tests, which reach the scan
    return packets.where("src_ip is not null and dst_ip is not null and protocol is not null").withColumns(
        {
            "dst_port": F.coalesce(F.col("dst_port").cast("int"), F.lit(0)),
            "protocol": F.col("protocol").cast("int"),
        }
    )


def _joined(parts: DataFrame, group: list[str], sums: list[str], merges: dict[str, Column]) -> DataFrame:
    """Neighbouring parts of a flow as one, with the gaps between them."""
    between = F.col("_from") - F.lag("_to").over(Window.partitionBy(*group).orderBy("_from"))
    return (
        parts.withColumn("_between", F.coalesce(between, F.lit(0.0)))
        .groupBy(*group)
        .agg(
            F.sum("_n").alias("_n"),
            *[F.sum(name).alias(name) for name in sums],
            *[c.alias(name) for name, c in merges.items()],
            F.max("_label").alias("_label"),
            F.min("_from").alias("_from"),
            F.max("_to").alias("_to"),
            F.sum(F.col("_gap2") + F.col("_between") * F.col("_between")).alias("_gap2"),
        )
    )


def _slices(spanned: DataFrame, place: list[str], sums: dict[str, Column], firsts: dict[str, Column]) -> DataFrame:
    """Step 1 over packets that carry the columns of ``place``."""
    before, after = F.slice("_at", F.lit(1), F.size("_at") - 1), F.slice("_at", F.lit(2), F.size("_at"))
    gaps = F.zip_with(before, after, lambda a, b: (b - a) * (b - a))
    return (
        spanned.groupBy(*place)
        .agg(
            F.count("*").alias("_n"),
            *[F.sum(c).alias(name) for name, c in sums.items()],
            *[c.alias(name) for name, c in firsts.items()],
            F.max("label").alias("_label"),
            F.sort_array(F.collect_set("timestamp")).alias("_at"),
        )
        .withColumns(
            {
                "_from": F.element_at("_at", 1),
                "_to": F.element_at("_at", -1),
                "_gap2": F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x),
            }
        )
        .drop("_at")
    )


def _gap_aggregate(
    spanned: DataFrame,
    keys: list[str],
    extra_means: dict[str, Column],
    slice_of: Column,
    overlap: float = 1.0,
    extremes: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Steps 1-3 over packets that carry first_window, last_window. ``extremes`` are further aggregates, each as the one
    over packets and the one that merges its values."""
    extremes = extremes or {}
    sums = {"_bytes": F.col("packet_length"), "_payload": F.col("payload_length"), **extra_means}
    merges = {name: merge for name, (_, merge) in extremes.items()}
    place = [*keys, "first_window", "last_window", "_slice"]
    parts = _slices(spanned.withColumn("_slice", slice_of), place, sums, {name: first for name, (first, _) in extremes.items()})
    if overlap > MANY_WINDOWS:
        coarse = parts.withColumn("_slice", F.floor(F.col("_slice") / COARSE))
        parts = _joined(coarse, place, list(sums), merges)
    group = ["window_id", *keys]
    placed = parts.withColumn("window_id", F.explode(F.sequence("first_window", "last_window")))
    joined = _joined(placed, group, list(sums), merges).select(
        *group, F.col("_n").alias("packet_count"), *sums, *extremes, (F.col("_to") - F.col("_from")).alias("_length"), "_gap2",
        F.col("_label").alias("label"),
    )
    n = F.col("packet_count")
    # the first packet's gap counts as 0, so the gaps of a flow add up to its length
    mean_gap = F.col("_length") / n
    variance = (F.col("_gap2") - n * mean_gap * mean_gap) / F.greatest(n - 1, F.lit(1))
    return joined.select(
        *group,
        n,
        F.col("_bytes").alias("total_bytes"),
        (F.col("_payload") / n).alias("mean_payload"),
        mean_gap.alias("mean_iat"),
        F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("std_iat"),
        *[(F.col(name) / n).alias(name) for name in extra_means],
        *extremes,
        F.col("label").cast("int").alias("label"),
    )


def sliding_flows(
    packets: DataFrame, size: float, stride: float, keep_tail: bool = False, splits: int = SPLITS, wide: bool = False
) -> DataFrame:
    """Flows of overlapping windows keyed by (window, src, dst, protocol, dst_port). ``splits`` slices per stride. ``wide`` adds
    the smallest and the largest packet and a sketch of the source ports, which merges like the sums do."""
    clean = prepare_packets(packets)
    windows = SlidingWindows.over(time_bounds(clean), size, stride, keep_tail)
    slice_of = F.floor((F.col("timestamp") - windows.origin) / (float(stride) / splits)).cast("long")
    extremes = {
        "min_packet_size": (F.min("packet_length"), F.min("min_packet_size")),
        "max_packet_size": (F.max("packet_length"), F.max("max_packet_size")),
        "src_ports": (F.hll_sketch_agg(F.col("src_port").cast("int"), F.lit(PORT_SKETCH)), F.hll_union_agg("src_ports")),
    }
    flows = _gap_aggregate(sliding_span(clean, windows), FLOW_KEY, {}, slice_of, size / stride, extremes if wide else None)
    if wide:
        flows = flows.withColumn("unique_src_ports", F.coalesce(F.hll_sketch_estimate("src_ports"), F.lit(0)))
    return flows.withColumn("window_start", windows.start(F.col("window_id")))


def port_entropy(packets: DataFrame, size: float, stride: float, port: str = "src_port", keys: list[str] | None = None) -> DataFrame:
    """(window_id, *keys, ports, port_entropy): distinct ports of a flow and the entropy, in bits, of its packets over them.

    Counted on two levels: packets per (flow, port) and set of windows, combined map-side, then per window. A group of the last
    aggregate is the distinct ports of one flow, as partial sums. Packets without a port do not count.
    """
    keys = keys or FLOW_KEY
    clean = prepare_packets(packets)
    windows = SlidingWindows.over(time_bounds(clean), size, stride)
    spanned = sliding_span(clean.where(F.col(port).isNotNull()), windows)
    counts = spanned.groupBy(*keys, F.col(port).alias("_port"), "first_window", "last_window").agg(F.count("*").alias("_n"))
    placed = counts.withColumn("window_id", F.explode(F.sequence("first_window", "last_window")))
    per_port = placed.groupBy("window_id", *keys, "_port").agg(F.sum("_n").alias("_n"))
    total, spread = F.sum("_n"), F.sum(F.col("_n") * F.log2("_n"))
    return per_port.groupBy("window_id", *keys).agg(F.count("*").alias("ports"), (F.log2(total) - spread / total).alias("port_entropy"))


def snapshot_flows(packets: DataFrame, delta_t: float = 5.0, splits: int = SPLITS) -> DataFrame:
    """Flows of tumbling windows keyed by (window, src, dst, protocol), with UDP length and the
    share of packets that open a connection."""
    t_min = time_bounds(packets)[0]
    placed = tumbling_window(packets, delta_t, t_min)
    spanned = placed.withColumns({"first_window": F.col("window_id"), "last_window": F.col("window_id")})
    spanned = spanned.drop("window_id")
    extra = {}
    if "udp_length" in packets.columns:
        extra["udp_length_mean"] = F.coalesce(F.col("udp_length"), F.lit(0.0))
    if "tcp_flags" in packets.columns:
        extra["tcp_flag_syn_rate"] = syn_flag(packets).cast("int")
    slice_of = F.floor(
        (F.col("timestamp") - F.col("window_start")) / F.lit(float(delta_t) / splits)
    ).cast("long")
    flows = _gap_aggregate(spanned, PAIR, extra, slice_of)
    for name in ("udp_length_mean", "tcp_flag_syn_rate"):
        if name not in flows.columns:
            flows = flows.withColumn(name, F.lit(0.0))
    return flows.withColumn("window_start", F.lit(t_min) + F.col("window_id") * F.lit(float(delta_t)))


def syn_flag(packets: DataFrame, column: str = "tcp_flags") -> Column:
    """Numeric flags: bit 2. Text flags: the letter S."""
    if packets.schema[column].dataType.typeName() == "string":
        return F.coalesce(F.col(column).contains("S"), F.lit(False))
    bits = F.coalesce(F.col(column).cast("long"), F.lit(0))
    return bits.bitwiseAND(F.lit(2)) == 2


def with_flow_ids(flows: DataFrame, store: Store) -> DataFrame:
    """Adds edge_idx (order of the flow in its window) and the flow id derived from it."""
    ranked = rank_within(flows, ["window_id"], FLOW_KEY, store, "edge_idx")
    return ranked.withColumn("flow_id", flow_id("window_id", "src_ip", "dst_ip", "edge_idx"))


def packet_gaps(packets: DataFrame, store: Store) -> DataFrame:
    """Time since the previous packet of the whole capture; 0 for the first."""
    lagged = previous_value(
        packets.select("packet_index", "timestamp"), ["timestamp", "packet_index"], "timestamp",
        store, "_previous",
    )
    return lagged.select(
        "packet_index",
        "timestamp",
        F.coalesce(F.col("timestamp") - F.col("_previous"), F.lit(0.0)).alias("inter_arrival_time"),
    )
