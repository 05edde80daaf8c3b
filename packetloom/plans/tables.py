"""The derived tables the registered queries read. Flows and counterfactuals are built once per
session and input folder, written to the shared folder, and read back with pruning and pushdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.operators.similarity import counterfactuals, feature_embeddings, nearest_normal
from packetloom.operators.flows import sliding_flows, with_flow_ids
from packetloom.sources import testviews
from packetloom.store import Store

_TABLES: dict[tuple[str, str], "Tables"] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.store = Store(spark)
        self._built: dict[str, DataFrame] = {}

    def once(self, name: str, build) -> DataFrame:
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def raw(self, name: str) -> DataFrame:
        return testviews.table(self.spark, self.sf_dir, name)

    @property
    def packets(self) -> DataFrame:
        """The packet view, stored as it comes: a write without a shuffle."""
        return self.once(
            "packets", lambda: self.store.save(testviews.packets(self.spark, self.sf_dir), "packets")
        )

    @property
    def labels(self) -> DataFrame:
        nine_in_ten = self.packets.where("packet_index % 10 <> 0")
        return nine_in_ten.select("packet_index", "label")

    @property
    def flows(self) -> DataFrame:
        def build() -> DataFrame:
            flows = sliding_flows(self.packets, testviews.WINDOW_SIZE, testviews.WINDOW_STRIDE)
            scored = testviews.with_test_scores(with_flow_ids(flows, self.store))
            return self.store.save(scored, "flows")

        return self.once("flows", build)

    @property
    def embeddings(self) -> DataFrame:
        return self.once(
            "embeddings", lambda: self.store.save(feature_embeddings(self.flows), "embeddings")
        )

    @property
    def counterfactuals(self) -> DataFrame:
        def build() -> DataFrame:
            neighbours = nearest_normal(self.embeddings, self.store)
            return self.store.save(counterfactuals(self.flows, neighbours), "counterfactuals")

        return self.once("counterfactuals", build)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]
