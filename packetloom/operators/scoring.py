"""Edge scores from a graph model with given weights, and a classifier trained on Spark.

The model looks at one window: node features pass once along the normalised edges, and every edge is
scored from both ends and its own features. Its first weight matrix depends on how many windows
come before. All arithmetic is plain column expressions, so windows of any size are joins and sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.cleaning import sanitise_features
from packetloom.functions.vectors import weighted_sum
from packetloom.operators.graph import graph_summaries, node_features, normalised_edges
from packetloom.operators.stats import NormStats, balanced_weight, classification_metrics, normalisation_stats, normalise
from packetloom.operators.windows import sequence_position, stratified_split, window_sequences
from packetloom.schemas import FEATURES, NODE_FEATURES
from packetloom.store import Store


@dataclass
class EdgeModel:
    """``node_weights[i]``: (node features x hidden) for the (i+1)-th window of a sequence;
    ``layers``: (weights, bias) pairs applied to [h_src, h_dst, edge features], ReLU in between."""

    node_weights: list[np.ndarray]
    layers: list[tuple[np.ndarray, np.ndarray]]
    hidden: int = field(init=False)

    def __post_init__(self) -> None:
        self.hidden = int(self.node_weights[0].shape[1])

    @classmethod
    def seeded(cls, hidden: int = 4, seq_len: int = 5, seed: int = 7) -> "EdgeModel":
        rng = np.random.default_rng(seed)
        node = [rng.normal(0, 0.5, (len(NODE_FEATURES), hidden)) for _ in range(seq_len)]
        width = 2 * hidden + len(FEATURES)
        layers = [
            (rng.normal(0, 0.5, (width, hidden)), rng.normal(0, 0.1, hidden)),
            (rng.normal(0, 0.5, (hidden, 1)), rng.normal(0, 0.1, 1)),
        ]
        return cls(node, layers)


@dataclass(frozen=True)
class Scaling:
    """What a job fits once and carries into scoring, so that a score does not depend on which other
    windows are scored with it: feature scales, and the number of the first window."""

    edges: NormStats
    nodes: NormStats
    first_window: int

    @classmethod
    def fit(cls, flows: DataFrame) -> "Scaling":
        clean = sanitise_features(flows, FEATURES)
        first = flows.agg(F.min("window_id")).first()[0]
        return cls(normalisation_stats(clean, FEATURES), normalisation_stats(node_features(clean), NODE_FEATURES), first or 0)

    def positions(self, windows: DataFrame, seq_len: int) -> DataFrame:
        """Windows before and with each one, empty ones included (at most ``seq_len``)."""
        place = F.col("window_id") - F.lit(self.first_window) + 1
        return windows.select("window_id", F.greatest(F.least(place, F.lit(seq_len)), F.lit(1)).cast("int").alias("position"))


def _h(i: int, side: str = "") -> str:
    return f"h{i}{side}"


def graph_convolution(flows: DataFrame, model: EdgeModel, scaling: Scaling | None = None) -> DataFrame:
    """h(dst) = sum over edges of norm * (x(src) W), before the ReLU, per (window, ip)."""
    fitted = scaling.nodes if scaling else None
    nodes = normalise(node_features(flows).select("window_id", "ip", *NODE_FEATURES), NODE_FEATURES, fitted)
    seq_len = len(model.node_weights)
    windows = flows.select("window_id").distinct()
    placed = nodes.join(scaling.positions(windows, seq_len) if scaling else sequence_position(windows, seq_len), "window_id")
    x = [F.col(f) for f in NODE_FEATURES]
    projected = {}
    for j in range(model.hidden):
        choice = weighted_sum(x, model.node_weights[-1][:, j])
        for p in range(seq_len - 1, 0, -1):
            choice = F.when(F.col("position") == p, weighted_sum(x, model.node_weights[p - 1][:, j])).otherwise(choice)
        projected[_h(j)] = choice
    sources = placed.select("window_id", F.col("ip").alias("src_ip"), *[c.alias(n) for n, c in projected.items()])
    weight = F.col("n") * F.col("norm")
    return (
        normalised_edges(flows)
        .join(sources, ["window_id", "src_ip"])
        .groupBy("window_id", F.col("dst_ip").alias("ip"))
        .agg(*[F.sum(weight * F.col(_h(j))).alias(_h(j)) for j in range(model.hidden)])
    )


def edge_inputs(flows: DataFrame, nodes: DataFrame, columns: list[str], fitted: NormStats | None = None) -> DataFrame:
    """Each edge with the columns of its source, of its target, and its own normalised features."""
    src = nodes.select("window_id", F.col("ip").alias("src_ip"), *[F.col(c).alias(f"{c}_src") for c in columns])
    dst = nodes.select("window_id", F.col("ip").alias("dst_ip"), *[F.col(c).alias(f"{c}_dst") for c in columns])
    edges = normalise(flows, FEATURES, fitted)
    return edges.join(src, ["window_id", "src_ip"]).join(dst, ["window_id", "dst_ip"])


def edge_embeddings(flows: DataFrame, model: EdgeModel, scaling: Scaling | None = None) -> DataFrame:
    """[h_src, h_dst, edge features] per flow, the input of the classifier."""
    hidden = [_h(j) for j in range(model.hidden)]
    active = graph_convolution(flows, model, scaling).withColumns({h: F.greatest(F.col(h), F.lit(0.0)) for h in hidden})
    return edge_inputs(sanitise_features(flows, FEATURES), active, hidden, scaling.edges if scaling else None)


def score_edges(flows: DataFrame, model: EdgeModel, scaling: Scaling | None = None) -> DataFrame:
    """(flow_id, window_id, prediction_score, prediction). Without a scaling it is fitted on ``flows`` themselves."""
    wide = edge_embeddings(flows, model, scaling)
    values: list[Column] = [
        *[F.col(f"{_h(j)}_src") for j in range(model.hidden)],
        *[F.col(f"{_h(j)}_dst") for j in range(model.hidden)],
        *[F.col(f) for f in FEATURES],
    ]
    for depth, (weights, bias) in enumerate(model.layers):
        names = [f"_l{depth}_{k}" for k in range(weights.shape[1])]
        last = depth == len(model.layers) - 1
        outs = [weighted_sum(values, weights[:, k]) + F.lit(float(bias[k])) for k in range(weights.shape[1])]
        wide = wide.withColumns(
            {n: (o if last else F.greatest(o, F.lit(0.0))) for n, o in zip(names, outs)}
        )
        values = [F.col(n) for n in names]
    score = 1 / (1 + F.exp(-values[0]))
    return wide.select("flow_id", "window_id", score.alias("prediction_score")).withColumn(
        "prediction", (F.col("prediction_score") >= 0.5).cast("int")
    )


# A scorer is any function from flows to (flow_id, prediction_score, prediction).
Scorer = Callable[[DataFrame], DataFrame]
_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    _SCORERS[name] = scorer


def scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise KeyError(f"unknown scorer {name}; known: {', '.join(sorted(_SCORERS))}")
    return _SCORERS[name]


def with_predictions(flows: DataFrame, scores: DataFrame) -> DataFrame:
    """Puts predictions on flows; flows without one keep nulls."""
    return flows.drop("prediction", "prediction_score").join(
        scores.select("flow_id", "prediction_score", "prediction"), "flow_id", "left"
    )


def window_scores(scored: DataFrame) -> DataFrame:
    """Mean score per window, 0 where nothing is scored."""
    return scored.groupBy("window_id").agg(
        F.coalesce(F.avg("prediction_score"), F.lit(0.0)).alias("anomaly_score"), F.count("*").alias("num_flows")
    )


register_scorer("seeded_graph_model", lambda flows: score_edges(flows, EdgeModel.seeded()))


CLASSIFIER_INPUTS = [*[f"{f}_src" for f in NODE_FEATURES], *[f"{f}_dst" for f in NODE_FEATURES], *FEATURES]


# --- training -------------------------------------------------------------------------------


def training_rows(flows: DataFrame, seq_len: int = 5) -> DataFrame:
    """Edges of the last window of every sequence with both ends' node features and the split."""
    clean = sanitise_features(flows, FEATURES)
    nodes = normalise(node_features(clean).select("window_id", "ip", *NODE_FEATURES), NODE_FEATURES)
    split = stratified_split(window_sequences(graph_summaries(flows), seq_len)).select(
        F.col("last_window").alias("window_id"), "split"
    )
    return edge_inputs(clean, nodes, NODE_FEATURES).join(split, "window_id")


def train_edge_classifier(
    flows: DataFrame,
    store: Store,
    strengths: tuple[float, ...] = (0.0, 0.05),
    max_iter: int = 50,
    seq_len: int = 5,
):
    """Class-weighted logistic regression; the penalty with the best validation F1 is kept.
    Returns (model, metrics per split)."""
    inputs = CLASSIFIER_INPUTS
    # every pass of the optimiser reads the assembled rows, so they are written once
    rows = training_rows(flows, seq_len).select("flow_id", "label", "split", *inputs)
    rows = store.save(rows, "training_rows", partition_by=["split"])
    train = rows.where("split = 'train'")
    train = train.withColumn("weight", balanced_weight(train))

    def evaluate(fitted, part: DataFrame) -> DataFrame:
        scored = fitted.transform(part).withColumn("prediction_score", vector_to_array("probability")[1])
        return classification_metrics(scored)

    best, best_f1 = None, -1.0
    for strength in strengths:
        stages = [
            VectorAssembler(inputCols=inputs, outputCol="assembled"),
            StandardScaler(inputCol="assembled", outputCol="features", withMean=True),
            LogisticRegression(weightCol="weight", regParam=strength, maxIter=max_iter),
        ]
        fitted = Pipeline(stages=stages).fit(train)
        f1 = evaluate(fitted, rows.where("split = 'val'")).first()["f1"]
        if f1 > best_f1:
            best, best_f1 = fitted, f1
    metrics = None
    for split in ("train", "val", "test"):
        part = evaluate(best, rows.where(F.col("split") == split)).withColumn("split", F.lit(split))
        metrics = part if metrics is None else metrics.unionByName(part)
    return best, metrics


def classifier_scorer(model: PipelineModel, scaling: Scaling) -> Scorer:
    """A trained classifier as a scorer, with the scales of its training data. The model is stored with
    ``model.save(path)`` and read with ``PipelineModel.load(path)``."""

    def score(flows: DataFrame) -> DataFrame:
        clean = sanitise_features(flows, FEATURES)
        nodes = node_features(clean).select("window_id", "ip", *NODE_FEATURES)
        rows = edge_inputs(clean, normalise(nodes, NODE_FEATURES, scaling.nodes), NODE_FEATURES, scaling.edges)
        rows = rows.select("flow_id", "window_id", *CLASSIFIER_INPUTS)
        scored = model.transform(rows).withColumn("prediction_score", vector_to_array("probability")[1])
        return scored.select(
            "flow_id", "window_id", "prediction_score", (F.col("prediction_score") >= 0.5).cast("int").alias("prediction")
        )

    return score
