"""Anomaly detection: by label, by score, by deviation from normal flows, and by deviation of a
source from its own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.severity import severity_of_z
from packetloom.operators.search import search_anomalous_flows, search_flows
from packetloom.operators.stats import MIN_STD
from packetloom.schemas import FEATURES

# Buckets a source needs before it is judged, and the z-score scale of a record.
MIN_HISTORY = 3
Z_SCALE = 3.0
INFLUENCERS = ["src_ip", "dst_ip", "protocol"]


def normal_baseline(flows: DataFrame, features: list[str] | None = None) -> Column:
    """avg and population deviation of label-0 flows, one scalar subquery."""
    fields = []
    for f in features or FEATURES:
        fields += [F.avg(f).alias(f"{f}_avg"), F.stddev_pop(f).alias(f"{f}_std")]
    return flows.where(F.col("label") == 0).agg(F.struct(*fields)).scalar()


def count_cutoff(flows: DataFrame) -> Column:
    """Mean + 2 deviations of normal packet counts; 0 without normal flows."""
    base = normal_baseline(flows, ["packet_count"])
    return F.coalesce(base["packet_count_avg"] + 2 * base["packet_count_std"], F.lit(0.0))


def detect_anomalies(
    flows: DataFrame, method: str = "label", threshold: float = 0.5, size: int | None = 50
) -> DataFrame:
    if method == "score":
        return search_anomalous_flows(flows, threshold, size)
    if method == "stats":
        over = flows.withColumn("cutoff", count_cutoff(flows)).where(F.col("packet_count") >= F.col("cutoff"))
        return search_flows(over, size=size)
    return search_flows(flows, [("label", "==", 1)], size)


def assess_severity(flows: DataFrame, baseline_of: DataFrame | None = None) -> DataFrame:
    """Largest |z| over the features against normal flows, and its class. Null features are skipped."""
    base = normal_baseline(baseline_of if baseline_of is not None else flows)
    out = flows.withColumn("_b", base)
    zs = {}
    for f in FEATURES:
        std = F.coalesce(F.col(f"_b.{f}_std"), F.lit(1.0))
        std = F.when(std <= 0, F.lit(1.0)).otherwise(std)
        zs[f"z_{f}"] = F.abs((F.col(f) - F.coalesce(F.col(f"_b.{f}_avg"), F.lit(0.0))) / std)
    out = out.withColumns(zs).drop("_b")
    top = F.coalesce(F.greatest(*[F.col(z) for z in zs]), F.lit(0.0))
    return out.withColumn("max_z_score", top).withColumn("severity", severity_of_z(F.col("max_z_score")))


def _buckets(flows: DataFrame, span: float) -> DataFrame:
    """One row per (source, time bucket): packets and mean bytes of its flows."""
    return flows.groupBy("src_ip", F.floor(F.col("window_start") / F.lit(float(span))).alias("bucket")).agg(
        F.sum("packet_count").cast("double").alias("high_count"),
        F.avg("total_bytes").alias("high_mean"),
    )


def scored_buckets(flows: DataFrame, span: float = 300.0) -> DataFrame:
    """Each bucket against the earlier buckets of its source. A group is one source's buckets, so it
    grows with the length of the capture and not with the traffic."""
    past = Window.partitionBy("src_ip").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    wide = _buckets(flows, span).withColumn("history", F.count("*").over(past))
    for d in ("high_count", "high_mean"):
        wide = wide.withColumns({f"{d}_m": F.avg(d).over(past), f"{d}_s": F.stddev_pop(d).over(past)})
    long = wide.where(F.col("history") >= MIN_HISTORY).selectExpr(
        "src_ip",
        "bucket",
        "stack(2, 'high_count', high_count, high_count_m, high_count_s,"
        " 'high_mean', high_mean, high_mean_m, high_mean_s) AS (detector, actual, typical, spread)",
    )
    spread = F.when(F.col("spread") < MIN_STD, F.lit(1.0)).otherwise(F.col("spread"))
    z = F.greatest((F.col("actual") - F.col("typical")) / spread, F.lit(0.0))
    return long.withColumn("record_score", 100 * (1 - F.exp(-z / Z_SCALE)))


def anomaly_records(
    flows: DataFrame, span: float = 300.0, min_score: float = 75.0, size: int | None = 50
) -> DataFrame:
    hits = scored_buckets(flows, span).where(F.col("record_score") >= min_score)
    hits = hits.orderBy(F.col("record_score").desc(), "src_ip", "bucket", "detector")
    return hits.limit(size) if size else hits


def influencers(
    flows: DataFrame, span: float = 300.0, min_record_score: float = 75.0, min_score: float = 50.0
) -> DataFrame:
    """Share of the excess packets of anomalous buckets that each field value carries."""
    records = (
        scored_buckets(flows, span)
        .where((F.col("record_score") >= min_record_score) & (F.col("detector") == "high_count"))
        .select("src_ip", "bucket", "actual", (F.col("actual") - F.col("typical")).alias("excess"))
    )
    # flows are summed per combination of field values before they meet the records
    parts = flows.groupBy(
        "src_ip", "dst_ip", "protocol", F.floor(F.col("window_start") / F.lit(float(span))).alias("bucket")
    ).agg(F.sum("packet_count").cast("double").alias("packets"))
    carried = parts.join(records, ["src_ip", "bucket"]).withColumn(
        "carried", F.col("excess") * F.col("packets") / F.col("actual")
    )
    total = records.agg(F.sum("excess")).scalar()
    pairs = ", ".join(f"'{f}', cast({f} as string)" for f in INFLUENCERS)
    return (
        carried.selectExpr("carried", f"stack({len(INFLUENCERS)}, {pairs}) AS (field, value)")
        .groupBy("field", "value")
        .agg(F.sum("carried").alias("carried"))
        .withColumn("influencer_score", 100 * F.col("carried") / total)
        .where(F.col("influencer_score") >= min_score)
        .select("field", "value", "influencer_score")
    )
