"""Spectral measures of window graphs: the second smallest eigenvalue of the normalised Laplacian
(how well connected) and the largest eigenvalue magnitude of the adjacency (how far one node reaches).

Windows with at most ``node_cap`` nodes are solved densely, one window per group, so a group holds
at most node_cap^2 matrix entries. Larger windows are iterated: nodes on no cycle are taken away first, then
a restarted Arnoldi iteration gives the radius of what is left and a restarted Lanczos iteration the gap. One step for
all windows is a join and sums; every step is written to the shared folder, so lineage stays short. Small
matrices of as many rows as the basis has vectors per window are solved in tasks. Iteration goes on until the residual of every
window is within the tolerance; a step has a fixed number of jobs, however many windows there are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.graph import adjacency, laplacian, node_set
from packetloom.store import Store

SCHEMA = "window_id long, spectral_gap double, spectral_radius double"
KEPT = 3 / 8  # share of the directions of a full basis that a restart keeps
CHECK = 10  # steps between looks at the residuals
VANISHED = 1e-12  # part of a vector below which what orthogonalisation left is rounding


def _dense_radius(adj: np.ndarray) -> float:
    """Only the part with cycles counts; eigenvalues of the rest are 0, but come out as noise."""
    while len(adj):
        keep = adj.any(axis=0) & adj.any(axis=1)
        if keep.all():
            return float(np.abs(np.linalg.eigvals(adj)).max())
        adj = adj[np.ix_(keep, keep)]
    return 0.0


def _dense(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = np.unique(pdf[["src_ip", "dst_ip"]].to_numpy().ravel())
    row = np.searchsorted(nodes, pdf["src_ip"].to_numpy())
    col = np.searchsorted(nodes, pdf["dst_ip"].to_numpy())
    adj = np.zeros((len(nodes), len(nodes)))
    adj[row, col] = pdf["weight"].to_numpy()
    binary = ((adj + adj.T) > 0).astype(float)
    scale = 1.0 / np.sqrt(binary.sum(axis=1))
    gaps = np.linalg.eigvalsh(np.eye(len(nodes)) - scale[:, None] * binary * scale[None, :])
    return pd.DataFrame(
        {
            "window_id": [int(pdf["window_id"].iloc[0])],
            "spectral_gap": [float(gaps[1]) if len(nodes) > 1 else 0.0],
            "spectral_radius": [_dense_radius(adj)],
        }
    )


def _start_value():
    # fixed pseudo-random start in (0, 1), the same on every run and every executor
    return (F.pmod(F.xxhash64("ip"), F.lit(9973)) + 1) / F.lit(9974.0)


def _normed(vector: DataFrame) -> DataFrame:
    length = vector.groupBy("window_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_len"))
    return vector.join(length, "window_id").select(
        "window_id", "ip", F.coalesce(F.try_divide("v", "_len"), F.lit(0.0)).alias("v")
    )


def _step(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """matrix (window_id, row, col, value) times vector (window_id, ip, v)."""
    return (
        matrix.join(vector.withColumnRenamed("ip", "col"), ["window_id", "col"])
        .groupBy("window_id", "row")
        .agg(F.sum(F.col("value") * F.col("v")).alias("v"))
        .withColumnRenamed("row", "ip")
    )


def _cyclic_core(adj: DataFrame, store: Store) -> DataFrame:
    """Edges left when nodes without both in- and out-edges are taken away until there are none; a
    window without a cycle has no edge left. Each round is two semi joins."""
    edges = store.save(adj, "core")
    left = edges.count()
    while left:
        heads = edges.select("window_id", F.col("dst_ip").alias("src_ip")).distinct()
        tails = edges.select("window_id", F.col("src_ip").alias("dst_ip")).distinct()
        edges = store.save(
            edges.join(heads, ["window_id", "src_ip"], "left_semi").join(tails, ["window_id", "dst_ip"], "left_semi"), "core"
        )
        before, left = left, edges.count()
        if left == before:
            break
    return edges


def _small_matrix(columns: list, head, tail) -> tuple[np.ndarray, np.ndarray]:
    """(b, last): the matrix on the basis of a window, and what multiplying the last vector left over."""
    first, size = columns[0]["j"], columns[-1]["j"] + 1
    small, last = np.zeros((size, size)), np.zeros(size)
    if first:
        small[:first, :first] = np.reshape(head, (first, first))
        small[first, :first] = tail
    for column in columns:
        j = column["j"]
        small[: j + 1, j] = np.add(column["d1"], column["d2"])[: j + 1]
        if j + 1 < size:
            small[j + 1, j] = column["beta"]
    last[-1] = columns[-1]["beta"]
    return small, last


def _ritz(columns: list, head, tail, symmetric: bool, kept: int) -> tuple:
    """(lam, residual, rotation, head, tail): the largest eigenvalue of the small matrix, and the ``kept`` directions of its
    largest ones, with which the next round starts. Both vectors of a conjugate pair stay or neither; zeros fill up."""
    small, last = _small_matrix(columns, head, tail)
    values, vectors = np.linalg.eigh((small + small.T) / 2) if symmetric else np.linalg.eig(small)
    order = np.argsort(-values.real, kind="stable")
    values, vectors = values[order], vectors[:, order]
    left = abs(last @ vectors[:, 0])
    if left <= len(small) * np.finfo(float).eps * np.linalg.norm(small):
        left = 0.0  # rounding of the products themselves
    count = min(kept, len(small))
    if count < len(small) and values[count - 1].imag and values[count - 1] == values[count].conj():
        count -= 1
    span = np.concatenate([vectors[:, :count].real, vectors[:, :count].imag], axis=1)
    rotation = np.zeros((len(small), kept))
    rotation[:, :count] = np.linalg.svd(span, full_matrices=False)[0][:, :count]
    lam = float(values[0].real)
    return lam, float(left / max(1.0, abs(lam))), rotation.T, rotation.T @ small @ rotation, rotation.T @ last


_RITZ = (
    "window_id long, lam double, residual double, rotation array<array<double>>, head array<double>, tail array<double>"
)


def _ritz_rows(coefficients: DataFrame, start: DataFrame, symmetric: bool, kept: int) -> DataFrame:
    """One row per window from its at most ``size`` rows of coefficients."""
    per_window = coefficients.groupBy("window_id").agg(
        F.sort_array(F.collect_list(F.struct("j", "d1", "d2", "beta"))).alias("columns")
    )

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                lam, residual, rotation, head, tail = _ritz(r.columns, r.head, r.tail, symmetric, kept)
                rows.append((r.window_id, lam, residual, [list(x) for x in rotation], list(head.ravel()), list(tail)))
            yield pd.DataFrame(rows, columns=["window_id", "lam", "residual", "rotation", "head", "tail"])

    return per_window.join(start, "window_id", "left").mapInPandas(run, _RITZ)


def _extended(matrix: DataFrame, state: DataFrame, j: int, store: Store) -> tuple[DataFrame, DataFrame]:
    """(state, coefficients) with one basis vector more: the matrix times vector ``j``, made orthogonal to all of the basis
    and to ``u``, twice, as one pass leaves too much of them after cancellation. Two tables are written."""
    vectors = [f"basis[{i}]" for i in range(j + 1)] + ["u"]
    sums = ", ".join(f"sum({v} * w)" for v in vectors)

    def without(name: str) -> str:
        return " - ".join(["w", *(f"{name}[{i}] * {v}" for i, v in enumerate(vectors))])

    moved = _step(matrix, state.selectExpr("window_id", "ip", f"basis[{j}] AS v")).withColumnRenamed("v", "w")
    both = state.join(moved, ["window_id", "ip"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    both = store.save(both, "krylov")
    d1 = both.groupBy("window_id").agg(F.expr(f"array({sums})").alias("d1"), F.expr("sum(w * w)").alias("before"))
    once = both.join(d1, "window_id").withColumn("w", F.expr(without("d1")))
    d2 = once.groupBy("window_id").agg(
        F.expr(f"array({sums})").alias("d2"), F.expr("sum(w * w)").alias("after"), F.first("d1").alias("d1"), F.first("before").alias("before")
    )
    # a vanishing remainder ends the recurrence: zeros from there on
    left = "sqrt(greatest(after - aggregate(d2, 0D, (total, d) -> total + d * d), 0D))"
    beta = F.expr(f"if({left} > {VANISHED}D * sqrt(before), {left}, 0D)")
    found = store.save(d2.select("window_id", F.lit(j).alias("j"), "d1", "d2", beta.alias("beta")), "krylov_coefficients")
    state = both.join(found, "window_id").withColumn("w", F.expr(without("d1"))).withColumn("w", F.expr(without("d2")))
    following = "concat(basis, array(if(beta > 0, w / beta, 0D))) AS basis"
    return state.selectExpr("window_id", "ip", "u", following), found


def _largest(
    matrix: DataFrame, nodes: DataFrame, symmetric: bool, store: Store, tolerance: float, max_steps: int, size: int
) -> DataFrame:
    """(window_id, lam, residual): the eigenvalue with the largest real part of the matrix of each window, outside
    the unit vector ``u`` of ``nodes`` (window_id, ip, u); all zeros exclude nothing.

    A node's row holds its entries of an orthogonal basis of at most size + 1 vectors. A full basis is turned into its
    best directions, KEPT of them, and the last vector, from which it grows again (thick restart), so rows stay short and nothing that was
    found is lost. A symmetric matrix gives Lanczos, any other Arnoldi. Windows within the tolerance leave at a restart."""
    start = nodes.withColumn("v", _start_value())
    along = start.groupBy("window_id").agg(F.sum(F.col("v") * F.col("u")).alias("_d"))
    start = start.join(along, "window_id").withColumn("v", F.col("v") - F.col("_d") * F.col("u"))
    first = _normed(start.select("window_id", "ip", "v")).join(nodes, ["window_id", "ip"])
    state = store.save(first.select("window_id", "ip", "u", F.array("v").alias("basis")), "krylov_start")
    before = store.spark.createDataFrame([], "window_id long, head array<double>, tail array<double>")
    done: list[DataFrame] = []
    kept, steps, j = int(size * KEPT), 0, 0
    coefficients: list[DataFrame] = []
    round_store = store.scratch("round")
    while True:
        state, found = _extended(matrix, state, j, round_store)
        coefficients.append(found)
        steps, j = steps + 1, j + 1
        full = j == size or steps == max_steps
        if not full and j % CHECK:
            continue
        ritz = _ritz_rows(reduce(DataFrame.unionByName, coefficients), before, symmetric, kept)
        ritz = store.save(ritz, "krylov_ritz")
        open_windows = ritz.where(F.col("residual") > tolerance)
        if steps == max_steps or open_windows.isEmpty():
            done.append(ritz)
            break
        if full:
            done.append(ritz.where(F.col("residual") <= tolerance))
            before = open_windows.select("window_id", "head", "tail")
            old = F.slice("basis", 1, size)
            turned = F.transform(
                "rotation",
                lambda row: F.aggregate(F.zip_with(old, row, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x),
            )
            state = state.join(open_windows.select("window_id", "rotation"), "window_id").select(
                "window_id", "ip", "u", F.concat(turned, F.array(F.col("basis")[size])).alias("basis")
            )
            following = store.scratch("round")
            state, j, coefficients = following.save(state, "krylov_restart"), kept, []
            round_store.clear()
            round_store = following
    return reduce(DataFrame.unionByName, [d.select("window_id", "lam", "residual") for d in done])


def _iterated(adj: DataFrame, flows: DataFrame, store: Store, tolerance: float, max_steps: int, size: int) -> DataFrame:
    nodes = store.save(node_set(flows, by_window=True), "power_nodes")
    one = nodes.select("window_id", F.col("ip").alias("row"), F.col("ip").alias("col"), F.lit(1.0).alias("value"))
    core = _cyclic_core(adj, store)
    core_nodes = core.select("window_id", F.col("src_ip").alias("ip"), F.lit(0.0).alias("u")).distinct()
    arrows = core.select(
        "window_id", F.col("src_ip").alias("row"), F.col("dst_ip").alias("col"), F.col("weight").cast("double").alias("value")
    )
    # no entry is negative, so the eigenvalue of largest magnitude is real and has the largest real part
    radius = _largest(arrows, core_nodes, False, store, tolerance, max_steps, size)
    within = F.col("residual") <= tolerance
    radius = radius.select("window_id", F.when(within, F.col("lam")).alias("radius"), F.col("residual").alias("r1"))
    # 2I - L turns the smallest eigenvalues of L into the largest; the null vector of L is sqrt(degree)
    lap = laplacian(flows, normalised=True)
    flipped = lap.select("window_id", "row", "col", (-F.col("value")).alias("value")).unionByName(
        one.withColumn("value", F.lit(2.0))
    )
    flipped = store.save(flipped.groupBy("window_id", "row", "col").agg(F.sum("value").alias("value")), "power_lap")
    degree = laplacian(flows).where("row <> col").groupBy("window_id", F.col("row").alias("ip")).agg(F.count("*").alias("d"))
    loops = flows.where("src_ip = dst_ip").select("window_id", F.col("src_ip").alias("ip")).distinct()
    degree = degree.unionByName(loops.withColumn("d", F.lit(1))).groupBy("window_id", "ip").agg(F.sum("d").alias("d"))
    null = _normed(degree.select("window_id", "ip", F.sqrt("d").alias("v"))).withColumnRenamed("v", "u")
    null = store.save(null, "power_null")
    gap = _largest(flipped, null, True, store, tolerance, max_steps, size)
    alone = nodes.groupBy("window_id").agg((F.count("*") == 1).alias("alone"))
    value = F.when(F.col("alone"), F.lit(0.0)).when(within, 2 - F.col("lam"))
    gap = gap.join(alone, "window_id").select("window_id", value.alias("spectral_gap"), F.col("residual").alias("r2"))
    # a window that lost all its edges has no cycle, and so radius 0
    return gap.join(radius, "window_id", "left").select(
        "window_id",
        "spectral_gap",
        F.when(F.col("r1").isNull(), F.lit(0.0)).otherwise(F.col("radius")).alias("spectral_radius"),
        F.greatest(F.coalesce("r1", F.lit(0.0)), "r2").alias("residual"),
    )


def spectral_measures(
    flows: DataFrame, store: Store, node_cap: int = 1000, tolerance: float = 1e-8, max_steps: int = 10_000, basis: int = 40
) -> DataFrame:
    """(window_id, spectral_gap, spectral_radius, residual).

    ``node_cap`` picks the way of computing, not the result: iterated values agree with dense ones to the
    tolerance. ``max_steps`` only ends what a caller does not want to wait for: a value that is not within the tolerance by then
    is null, and the residual says by how much. A chain of 1,000 nodes, whose gap is 5e-6, takes about 2,000 steps.
    ``basis`` is the number of vectors an iterated window keeps, so a row per node holds as many numbers."""
    sizes = node_set(flows, by_window=True).groupBy("window_id").agg(F.count("*").alias("_n"))
    adj = adjacency(flows)
    small = adj.join(sizes.where(F.col("_n") <= node_cap).select("window_id"), "window_id")
    dense = small.groupBy("window_id").applyInPandas(_dense, SCHEMA).withColumn("residual", F.lit(0.0))
    scratch = store.scratch("spectral")
    try:
        large = scratch.save(sizes.where(F.col("_n") > node_cap).select("window_id"), "large_windows")
        if large.isEmpty():
            return dense
        rest = flows.join(large, "window_id").select("window_id", "src_ip", "dst_ip", "label", "total_bytes", "packet_count")
        rest = scratch.save(rest, "large_flows")
        found = store.save(_iterated(adjacency(rest), rest, scratch, tolerance, max_steps, basis), "large_spectra")
    finally:
        scratch.clear()
    return dense.unionByName(found)


def spectral_extremes(spectra: DataFrame, top_k: int = 5) -> DataFrame:
    """Least connected windows and windows with the largest reach."""
    low = spectra.orderBy("spectral_gap", "window_id").limit(top_k).withColumn("kind", F.lit("fragmented"))
    high = (
        spectra.orderBy(F.col("spectral_radius").desc(), "window_id")
        .limit(top_k)
        .withColumn("kind", F.lit("amplified"))
    )
    return low.unionByName(high)
