"""Times the headline queries; prints one JSON line.

Building the stored tables (flows, counterfactuals) is timed on its own, so the times of the
queries that read them are those of the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from packetloom.plans import catalog
from packetloom.plans.queries_models import document_index
from packetloom.plans.tables import tables
from packetloom.session import build_session

HEADLINE = [
    "feature_stats_by_label",
    "sliding_windows",
    "snapshot_flows",
    "node_features",
    "graph_summaries",
    "edge_removal",
    "window_feature_comparison",
    "spectral_measures",
    "feature_percentiles",
    "significant_src_ip",
    "severity_breakdown",
    "severity_assessment",
    "anomaly_records",
    "influencers",
    "detect_by_stats",
    "search_by_severity",
    "flow_page_first",
    "incident_graph_nodes",
    "feature_embeddings",
    "similar_vectors",
    "counterfactual_narratives",
    "document_search",
    "indexed_search",
    "graph_convolution",
    "edge_scores",
    "window_sequences",
    "normalised_edges",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus), spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
    spark.range(1).count()  # session start is not part of any query
    derived = tables(spark, sf_dir)
    times = {
        "build_packet_table": timed(lambda: derived.packets),
        "build_flow_table": timed(lambda: derived.flows),
        "build_counterfactual_table": timed(lambda: derived.counterfactuals),
        "build_text_index": timed(lambda: document_index(derived)),
    }
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        # noop runs the whole plan and drops the rows
        take = [
            timed(lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()) for _ in range(runs)
        ]
        times[name] = statistics.median(take)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
