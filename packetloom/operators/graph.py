"""Window graphs as two tables: flows are the edges, (window_id, ip) rows are the nodes.

Everything is keyed by window, so one plan covers all windows. Endpoint aggregates run on
(window_id, ip) with map-side combining; window totals are taken from the node table, one level up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.ordered import rank_within
from packetloom.schemas import FEATURES
from packetloom.store import Store

TINY = 1e-9


def node_features(flows: DataFrame) -> DataFrame:
    """Bytes and packets sent and received, out- and in-degree per (window, ip)."""
    zero = F.lit(0)
    sent = F.struct(
        F.col("src_ip").alias("ip"),
        F.col("total_bytes").alias("bs"),
        zero.cast(flows.schema["total_bytes"].dataType).alias("br"),
        F.col("packet_count").alias("ps"),
        zero.cast(flows.schema["packet_count"].dataType).alias("pr"),
        F.lit(1).alias("od"),
        zero.alias("idg"),
        (F.col("label") == 1).cast("int").alias("mal"),
    )
    received = F.struct(
        F.col("dst_ip").alias("ip"),
        zero.cast(flows.schema["total_bytes"].dataType).alias("bs"),
        F.col("total_bytes").alias("br"),
        zero.cast(flows.schema["packet_count"].dataType).alias("ps"),
        F.col("packet_count").alias("pr"),
        zero.alias("od"),
        F.lit(1).alias("idg"),
        zero.alias("mal"),
    )
    # both ends of an edge in one pass: a union would work out the edges twice
    return (
        flows.select("window_id", F.inline(F.array(sent, received)))
        .groupBy("window_id", "ip")
        .agg(
            F.sum("bs").alias("bytes_sent"),
            F.sum("br").alias("bytes_recv"),
            F.sum("ps").alias("pkts_sent"),
            F.sum("pr").alias("pkts_recv"),
            F.sum("od").alias("out_degree"),
            F.sum("idg").alias("in_degree"),
            F.sum("mal").alias("malicious_out"),
        )
    )


def node_set(df: DataFrame, by_window: bool = False) -> DataFrame:
    """Distinct addresses seen as source or destination."""
    keys = ["window_id"] if by_window else []
    src = df.select(*keys, F.col("src_ip").alias("ip"))
    return src.union(df.select(*keys, F.col("dst_ip").alias("ip"))).distinct()


def node_ids(df: DataFrame, store: Store) -> DataFrame:
    """Addresses with dense ids in text order."""
    return rank_within(node_set(df), [], ["ip"], store, "node_id")


def edges_by_id(flows: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with the ids of both ends next to their addresses."""
    src = ids.withColumnsRenamed({"ip": "src_ip", "node_id": "src_id"})
    dst = ids.withColumnsRenamed({"ip": "dst_ip", "node_id": "dst_id"})
    return flows.join(src, "src_ip").join(dst, "dst_ip")


def graph_summaries(flows: DataFrame) -> DataFrame:
    """Nodes, edges, mean degree, density and malicious share per window."""
    n, e = F.col("num_nodes"), F.col("num_edges")
    return (
        node_features(flows)
        .groupBy("window_id")
        .agg(
            F.count("*").alias("num_nodes"),
            F.sum("out_degree").alias("num_edges"),
            F.sum("malicious_out").alias("num_malicious"),
        )
        .withColumns(
            {
                "mean_degree": F.lit(2.0) * e / n,
                "density": e / F.greatest(n * (n - 1), F.lit(1)),
                "malicious_ratio": F.col("num_malicious") / e,
            }
        )
    )


def with_window_start(summaries: DataFrame, flows: DataFrame) -> DataFrame:
    starts = flows.groupBy("window_id").agg(F.min("window_start").alias("window_start"))
    return summaries.join(starts, "window_id")


def dataset_summary(flows: DataFrame) -> DataFrame:
    return graph_summaries(flows).agg(
        F.count("*").alias("num_graphs"),
        F.sum("num_edges").alias("total_edges"),
        F.avg("num_edges").alias("avg_edges"),
        F.avg("num_nodes").alias("avg_nodes"),
    )


def class_shares(flows: DataFrame) -> DataFrame:
    per_class = flows.groupBy("label").agg(F.count("*").alias("n"))
    total = flows.agg(F.count("*")).scalar()
    return per_class.withColumn("percent", F.lit(100.0) * F.col("n") / total)


def _first_window(summaries: DataFrame, sign: int) -> Column:
    order = F.struct(F.lit(sign) * F.col("malicious_ratio"), F.col("window_id"))
    return F.min_by("window_id", order)


def recent_windows(summaries: DataFrame, size: int) -> DataFrame:
    return summaries.orderBy(F.col("window_id").desc()).limit(size)


def extreme_window(summaries: DataFrame, kind: str = "anomalous") -> DataFrame:
    """Window with the highest (lowest) malicious share, the first on ties."""
    ratio = F.col("malicious_ratio")
    order = ratio.desc() if kind == "anomalous" else ratio.asc()
    return summaries.orderBy(order, "window_id").limit(1)


# --- degrees and matrices -------------------------------------------------------------------


def degrees(flows: DataFrame) -> DataFrame:
    nodes = node_features(flows)
    return nodes.select(
        "window_id",
        "ip",
        "out_degree",
        "in_degree",
        (F.col("out_degree") + F.col("in_degree")).alias("total_degree"),
    )


def degree_matrix(flows: DataFrame, mode: str = "out") -> DataFrame:
    column = {"out": "out_degree", "in": "in_degree"}.get(mode, "total_degree")
    return degrees(flows).select(
        "window_id", F.col("ip").alias("row"), F.col("ip").alias("col"), F.col(column).alias("value")
    )


def adjacency(flows: DataFrame) -> DataFrame:
    """Parallel edges add up."""
    return flows.groupBy("window_id", "src_ip", "dst_ip").agg(F.count("*").alias("weight"))


def _symmetric(flows: DataFrame) -> DataFrame:
    pairs = adjacency(flows)
    there = pairs.select("window_id", F.col("src_ip").alias("row"), F.col("dst_ip").alias("col"))
    back = pairs.select("window_id", F.col("dst_ip").alias("row"), F.col("src_ip").alias("col"))
    return there.union(back).distinct()


def laplacian(flows: DataFrame, normalised: bool = False) -> DataFrame:
    """(window, row, col, value) entries over the symmetrised, 0/1 adjacency."""
    sym = _symmetric(flows)
    deg = sym.groupBy("window_id", "row").agg(F.count("*").alias("deg"))
    if normalised:
        col_deg = deg.withColumnsRenamed({"row": "col", "deg": "col_deg"})
        off = (
            sym.join(deg, ["window_id", "row"])
            .join(col_deg, ["window_id", "col"])
            .select("window_id", "row", "col", (-F.lit(1.0) / F.sqrt(F.col("deg") * F.col("col_deg"))).alias("value"))
        )
        diagonal = deg.select("window_id", "row", F.col("row").alias("col"), F.lit(1.0).alias("value"))
    else:
        off = sym.select("window_id", "row", "col", F.lit(-1.0).alias("value"))
        diagonal = deg.select(
            "window_id", "row", F.col("row").alias("col"), F.col("deg").cast("double").alias("value")
        )
    return (
        off.unionByName(diagonal).groupBy("window_id", "row", "col").agg(F.sum("value").alias("value"))
    )


def edges_with_loops(flows: DataFrame) -> DataFrame:
    """Edges plus one loop per node."""
    nodes = node_set(flows, by_window=True)
    loops = nodes.select("window_id", F.col("ip").alias("src_ip"), F.col("ip").alias("dst_ip"))
    return flows.select("window_id", "src_ip", "dst_ip").unionAll(loops)


def normalised_edges(flows: DataFrame) -> DataFrame:
    """Edges with loops, weighted d(src)^-1/2 * d(dst)^-1/2; d is the in-degree with the loop.

    Equal edges are counted first, so a busy pair of hosts is one row in the joins. A loop needs no join: its row is that of
    its node, to which edges from a node to itself are added.
    """
    nodes = node_features(flows).select("window_id", "ip", (F.col("in_degree") + 1).alias("deg"))
    src = nodes.withColumnsRenamed({"ip": "src_ip", "deg": "src_deg"})
    dst = nodes.withColumnsRenamed({"ip": "dst_ip", "deg": "dst_deg"})
    norm = (F.lit(1.0) / F.sqrt("src_deg") * (F.lit(1.0) / F.sqrt("dst_deg"))).alias("norm")
    between = adjacency(flows.where("src_ip <> dst_ip")).withColumnRenamed("weight", "n")
    between = between.join(src, ["window_id", "src_ip"]).join(dst, ["window_id", "dst_ip"])
    own = adjacency(flows.where("src_ip = dst_ip")).select("window_id", F.col("src_ip").alias("ip"), "weight")
    loops = nodes.where("window_id is not null and ip is not null").join(own, ["window_id", "ip"], "left").select(
        "window_id",
        F.col("ip").alias("src_ip"),
        F.col("ip").alias("dst_ip"),
        (F.coalesce("weight", F.lit(0)) + 1).cast("long").alias("n"),
        F.col("deg").alias("src_deg"),
        F.col("deg").alias("dst_deg"),
    )
    columns = ["window_id", "src_ip", "dst_ip", "n"]
    return between.select(*columns, norm).unionAll(loops.select(*columns, norm))


# --- what-ifs -------------------------------------------------------------------------------


def edge_removal(flows: DataFrame, max_removals: int = 5, chosen: DataFrame | None = None) -> DataFrame:
    """What each window would look like without one edge: change of the mean of every feature and
    of the spread of the degrees, for the largest malicious edges (any edge if none is malicious), or for
    the ``chosen`` ones (window_id, edge_idx). The removed edge's own features are in ``edge_...``; rows of a
    window come in the order of their impact.

    Works from window totals and the removed edge alone, so no edge meets another edge.
    """
    deg = degrees(flows).select("window_id", "ip", F.col("total_degree").cast("double").alias("deg"))
    totals = flows.groupBy("window_id").agg(
        F.count("*").alias("_edges"),
        F.sum((F.col("label") == 1).cast("int")).alias("_mal"),
        *[F.sum(F.col(f).cast("double")).alias(f"_sum_{f}") for f in FEATURES],
    )
    spread = deg.groupBy("window_id").agg(
        F.count("*").alias("_nodes"), F.sum(F.col("deg") * F.col("deg")).alias("_deg2")
    )
    order = Window.partitionBy("window_id").orderBy(
        (F.col("label") == 1).desc(), F.col("total_bytes").desc(), F.col("edge_idx")
    )
    if chosen is None:
        ranked = flows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max_removals)
        wanted = (F.col("label") == 1) | (F.col("_mal") == 0)
    else:
        ranked = flows.join(chosen.select("window_id", "edge_idx").distinct(), ["window_id", "edge_idx"], "left_semi")
        wanted = F.lit(True)
    targets = (
        ranked.join(totals, "window_id")
        .where(wanted & (F.col("_edges") >= 2))
        .join(spread, "window_id")
        .join(deg.withColumnsRenamed({"ip": "src_ip", "deg": "_ds"}), ["window_id", "src_ip"])
        .join(deg.withColumnsRenamed({"ip": "dst_ip", "deg": "_dd"}), ["window_id", "dst_ip"])
    )
    edges, nodes, ds, dd = (F.col(c) for c in ("_edges", "_nodes", "_ds", "_dd"))
    # degrees add up to twice the edges; a removed edge takes one from each end, a loop two from one
    mean_before, mean_after = 2 * edges / nodes, 2 * (edges - 1) / nodes
    std_before = F.sqrt(F.greatest(F.col("_deg2") / nodes - mean_before * mean_before, F.lit(0.0)))
    lost = F.when(F.col("src_ip") == F.col("dst_ip"), 4 * ds - 4).otherwise(2 * ds + 2 * dd - 2)
    std_after = F.sqrt(
        F.greatest((F.col("_deg2") - lost) / nodes - mean_after * mean_after, F.lit(0.0))
    )
    impacts = {}
    for f in FEATURES:
        mean = F.col(f"_sum_{f}") / edges
        delta = (F.col(f"_sum_{f}") - F.col(f)) / (edges - 1) - mean
        impacts[f"{f}_delta"] = F.round(delta, 4)
        impacts[f"{f}_pct_change"] = F.round(
            F.abs(delta) / F.greatest(F.abs(mean), F.lit(TINY)) * 100, 2
        )
    removed = targets.select(
        "window_id",
        "edge_idx",
        "src_ip",
        "dst_ip",
        F.col("label").alias("removed_label"),
        *[F.col(f).cast("double").alias(f"edge_{f}") for f in FEATURES],
        *[c.alias(name) for name, c in impacts.items()],
        F.round(F.abs(std_after - std_before) / F.greatest(std_before, F.lit(TINY)), 4).alias(
            "structural_impact"
        ),
    )
    return removed.orderBy("window_id", F.col("structural_impact").desc(), "edge_idx")


def _pick_windows(summaries: DataFrame) -> Column:
    """(most normal, most anomalous); first and last window when they are the same one."""
    a, b = _first_window(summaries, 1), _first_window(summaries, -1)
    return (
        summaries.agg(
            a.alias("a"), b.alias("b"), F.min("window_id").alias("lo"), F.max("window_id").alias("hi")
        )
        .select(
            F.struct(
                F.when(F.col("a") == F.col("b"), F.col("lo")).otherwise(F.col("a")).alias("a"),
                F.when(F.col("a") == F.col("b"), F.col("hi")).otherwise(F.col("b")).alias("b"),
            )
        )
        .scalar()
    )


def _two_windows(flows: DataFrame, window_a: int | None, window_b: int | None) -> DataFrame:
    if window_a is not None and window_b is not None:
        pick = F.struct(F.lit(window_a).alias("a"), F.lit(window_b).alias("b"))
    else:
        pick = _pick_windows(graph_summaries(flows))
    return (
        flows.withColumn("_pick", pick)
        .where((F.col("window_id") == F.col("_pick.a")) | (F.col("window_id") == F.col("_pick.b")))
        .withColumns(
            {
                "_in_a": F.col("window_id") == F.col("_pick.a"),
                "_in_b": F.col("window_id") == F.col("_pick.b"),
            }
        )
    )


def compare_features(
    flows: DataFrame, window_a: int | None = None, window_b: int | None = None
) -> DataFrame:
    """Mean of each feature in both windows, difference, percentage and direction."""
    pair = _two_windows(flows, window_a, window_b)
    wide = pair.agg(
        *[F.avg(F.when(F.col(s), F.col(f))).alias(f"{f}{s}") for f in FEATURES for s in ("_in_a", "_in_b")]
    )
    stacked = ", ".join(f"'{f}', {f}_in_a, {f}_in_b" for f in FEATURES)
    long = wide.selectExpr(f"stack({len(FEATURES)}, {stacked}) AS (feature, mean_a, mean_b)")
    delta = F.col("mean_b") - F.col("mean_a")
    return long.select(
        "feature",
        F.round("mean_a", 4).alias("window_a_mean"),
        F.round("mean_b", 4).alias("window_b_mean"),
        F.round(delta, 4).alias("delta"),
        F.round(F.abs(delta) / F.greatest(F.abs("mean_a"), F.lit(TINY)) * 100, 2).alias("pct_change"),
        F.when(delta > 0, "increase").when(delta < 0, "decrease").otherwise("unchanged").alias("direction"),
    )


def compare_structure(
    flows: DataFrame, window_a: int | None = None, window_b: int | None = None
) -> DataFrame:
    """Size, degree and label differences of two windows, as one row."""
    pair = _two_windows(flows, window_a, window_b)
    ends = pair.select(F.col("src_ip").alias("ip"), "_in_a", "_in_b", "label", F.lit(1).alias("e"), "window_id", "window_start").unionAll(
        pair.select(F.col("dst_ip").alias("ip"), "_in_a", "_in_b", "label", F.lit(0).alias("e"), "window_id", "window_start")
    )
    per_node = ends.groupBy("ip").agg(
        *[
            F.sum(F.when(F.col(s) & (F.col("e") == 1) & cond, 1).otherwise(0)).alias(f"{name}{s}")
            for s in ("_in_a", "_in_b")
            for name, cond in (
                ("edges", F.lit(True)),
                ("normal", F.col("label") == 0),
                ("malicious", F.col("label") == 1),
            )
        ],
        *[F.max(F.when(F.col(s), 1).otherwise(0)).alias(f"node{s}") for s in ("_in_a", "_in_b")],
        *[F.max(F.when(F.col(s), F.col("window_id"))).alias(f"id{s}") for s in ("_in_a", "_in_b")],
        *[F.max(F.when(F.col(s), F.col("window_start"))).alias(f"start{s}") for s in ("_in_a", "_in_b")],
    )
    row = per_node.agg(
        *[
            F.sum(f"{name}{s}").alias(f"{name}{s}")
            for name in ("node", "edges", "normal", "malicious")
            for s in ("_in_a", "_in_b")
        ],
        *[F.max(f"{name}{s}").alias(f"{name}{s}") for name in ("id", "start") for s in ("_in_a", "_in_b")],
    )
    out = []
    for s, name in (("_in_a", "a"), ("_in_b", "b")):
        out += [
            F.col(f"id{s}").alias(f"window_{name}"),
            F.col(f"start{s}").alias(f"start_{name}"),
            F.col(f"node{s}").alias(f"nodes_{name}"),
            F.col(f"edges{s}").alias(f"edges_{name}"),
            F.round(2 * F.col(f"edges{s}") / F.col(f"node{s}"), 2).alias(f"mean_degree_{name}"),
        ]
    degree = {s: 2 * F.col(f"edges{s}") / F.col(f"node{s}") for s in ("_in_a", "_in_b")}
    return row.select(
        *out,
        (F.col("node_in_b") - F.col("node_in_a")).alias("node_diff"),
        (F.col("edges_in_b") - F.col("edges_in_a")).alias("edge_diff"),
        F.round(degree["_in_b"] - degree["_in_a"], 4).alias("degree_shift"),
        (F.col("normal_in_b") - F.col("normal_in_a")).alias("normal_delta"),
        (F.col("malicious_in_b") - F.col("malicious_in_a")).alias("malicious_delta"),
    )
