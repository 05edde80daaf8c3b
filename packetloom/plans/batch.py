"""End-to-end jobs: packets to stored flows, summaries, embeddings, counterfactuals and a report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.cleaning import nonfinite_to_null, sanitise_features
from packetloom.operators import flows as fl
from packetloom.operators import graph as g
from packetloom.operators import similarity as si
from packetloom.operators import stats
from packetloom.operators.spectral import spectral_measures
from packetloom.operators.windows import window_sequences
from packetloom.schemas import FEATURES, NODE_FEATURES
from packetloom.sources.sinks import write_by_window
from packetloom.store import Store


@dataclass
class BatchResult:
    packets: DataFrame
    flows: DataFrame
    summaries: DataFrame
    embeddings: DataFrame
    counterfactuals: DataFrame


def ingest(
    packets: DataFrame, store: Store, size: float = 2.0, stride: float = 1.0, max_counterfactuals: int | None = None
) -> BatchResult:
    """Everything is written once and read back by the steps after it. Every malicious flow has a row among the
    counterfactuals; without any normal flow it has no neighbour there."""
    clean = store.save(nonfinite_to_null(packets), "packets")
    ided = fl.with_flow_ids(fl.sliding_flows(clean, size, stride), store)
    path = write_by_window(ided, store.fresh_path("flows"))
    flows = store.spark.read.parquet(path).select(*ided.columns)
    shape = g.with_window_start(g.graph_summaries(flows), flows)
    summaries = store.save(shape.join(spectral_measures(flows, store), "window_id", "left"), "summaries")
    embeddings = store.save(si.feature_embeddings(flows), "embeddings")
    asked = embeddings.where("label = 1")
    if max_counterfactuals is not None:
        first = si.first_malicious(flows, max_counterfactuals).select("flow_id")
        asked = asked.join(first, "flow_id", "left_semi")
    found = si.nearest(asked, embeddings.where("label = 0"), store, 1)
    found = store.save(found, "neighbours")  # read for the flows with a neighbour and for those without
    cfs = si.counterfactuals(flows, found)
    cfs = store.save(cfs.unionByName(si.unmatched(asked, found, cfs)), "counterfactuals")
    return BatchResult(clean, flows, summaries, embeddings, cfs)


def ingest_report(result: BatchResult) -> DataFrame:
    """Row counts of the tables, one row each."""
    counts = [
        getattr(result, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
        for name in ("packets", "flows", "summaries", "embeddings", "counterfactuals")
    ]
    return reduce(DataFrame.unionByName, counts)


def feature_report(flows: DataFrame, store: Store) -> DataFrame:
    """Feature statistics, percentiles of the packet count and tell-tale addresses in long form."""

    def rows(df: DataFrame, section: str, item: list[str], value: str) -> DataFrame:
        parts = [F.col(c).cast("string") for c in item]
        return df.select(
            F.lit(section).alias("section"), F.concat_ws(":", *parts).alias("item"), F.col(value).cast("double").alias("value")
        )

    summary = stats.feature_stats(flows)
    sections = [
        rows(summary, "average", ["feature", "label"], "avg_value"),
        rows(summary, "deviation", ["feature", "label"], "std_value"),
        rows(
            stats.percentiles(flows, ["packet_count"], store).withColumn("percent", F.col("percent").cast("int")),
            "percentile", ["feature", "label", "percent"], "value",
        ),
        rows(stats.significant_terms(flows, "src_ip"), "significant_source", ["term"], "score"),
        rows(stats.significant_terms(flows, "dst_ip"), "significant_target", ["term"], "score"),
    ]
    return reduce(DataFrame.unionByName, sections)


def prepare_window(
    window_flows: DataFrame, edge_stats: stats.NormStats, node_stats: stats.NormStats
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, weighted edges with loops) of new windows, scaled with fitted stats."""
    clean = sanitise_features(window_flows, FEATURES)
    nodes = g.node_features(clean).select("window_id", "ip", *NODE_FEATURES)
    return (
        stats.normalise(clean, FEATURES, edge_stats),
        stats.normalise(nodes, NODE_FEATURES, node_stats),
        g.normalised_edges(clean),
    )


def temporal_dataset(
    packets: DataFrame,
    labels: DataFrame | None,
    store: Store,
    size: float,
    stride: float,
    seq_len: int = 5,
    seq_stride: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, weighted edges with loops, sequences), normalised and ready for scoring or training.

    Flows and nodes are written once; scales, results and sequences are read from there."""
    labelled = fl.merge_labels(packets.drop("label"), labels) if labels is not None else packets
    flows = store.save(sanitise_features(fl.sliding_flows(labelled, size, stride), FEATURES), "dataset-flows")
    nodes = store.save(g.node_features(flows).select("window_id", "ip", *NODE_FEATURES), "dataset-nodes")
    return (
        stats.normalise(flows, FEATURES),
        stats.normalise(nodes, NODE_FEATURES),
        g.normalised_edges(flows),
        window_sequences(g.graph_summaries(flows), seq_len, seq_stride),
    )
