import os

import numpy as np
import pytest

from packetloom.operators import graph as g
from packetloom.operators.spectral import spectral_measures
from packetloom.schemas import FEATURES
from packetloom.store import Store


@pytest.fixture(scope="module")
def make_flows(spark):
    """Edges of (window, src, dst[, bytes, packets, label]) as flows."""

    def build(edges):
        rows, seen = [], {}
        for e in edges:
            w, s, d = e[:3]
            size, packets, label = (list(e[3:]) + [100, 5, 0][len(e) - 3 :])[:3]
            idx = seen[w] = seen.get(w, -1) + 1
            rows.append((f"f{w}-{idx}", w, float(w), str(s), str(d), 6, 80, idx, packets, size, size / packets, 0.25 * idx, 0.1 * idx, label))
        return spark.createDataFrame(
            rows,
            "flow_id string, window_id long, window_start double, src_ip string, dst_ip string, protocol int, dst_port int,"
            " edge_idx long, packet_count long, total_bytes long, mean_payload double, mean_iat double, std_iat double, label int",
        )

    return build


SAMPLE = [(0, 0, 1), (0, 0, 2), (0, 1, 2), (0, 2, 3), (0, 3, 1)]


def test_sample_graph_degrees(make_flows):
    rows = {r.ip: r for r in g.degrees(make_flows(SAMPLE)).collect()}
    assert [rows[str(i)].out_degree for i in range(4)] == [2, 1, 1, 1]
    assert [rows[str(i)].in_degree for i in range(4)] == [0, 2, 2, 1]
    assert g.adjacency(make_flows(SAMPLE)).count() == 5


def test_parallel_edges_add_up(make_flows):
    (row,) = g.adjacency(make_flows([(0, 0, 1)] * 3)).collect()
    assert row.weight == 3


def test_node_features(make_flows):
    rows = {r.ip: r for r in g.node_features(make_flows([(0, 0, 1, 100, 5), (0, 1, 2, 200, 10)])).collect()}
    assert (rows["0"].bytes_sent, rows["0"].out_degree, rows["0"].bytes_recv) == (100, 1, 0)
    assert (rows["1"].bytes_recv, rows["1"].bytes_sent, rows["1"].pkts_sent) == (100, 200, 10)


def test_self_loop_counts_on_both_sides(make_flows):
    (row,) = g.node_features(make_flows([(0, 0, 0, 100, 5)])).collect()
    assert row.bytes_sent == row.bytes_recv == 100 and row.in_degree == row.out_degree == 1


def test_extreme_windows(make_flows):
    flows = make_flows([(0, 0, 1), (1, 0, 1, 100, 5, 1), (1, 1, 0), (2, 0, 1, 100, 5, 1), (2, 1, 0)])
    summaries = g.graph_summaries(flows)
    assert g.extreme_window(summaries, "anomalous").first().window_id == 1  # the first of a tie
    assert g.extreme_window(summaries, "normal").first().window_id == 0
    assert g.extreme_window(summaries.limit(0)).count() == 0


def test_comparison_takes_first_and_last_when_all_are_alike(make_flows):
    flows = make_flows([(0, 0, 1), (1, 0, 1), (2, 0, 1), (2, 1, 2)])
    row = g.compare_structure(flows).first()
    assert (row.window_a, row.window_b, row.edge_diff, row.node_diff) == (0, 2, 1, 1)
    features = {r.feature: r for r in g.compare_features(flows, 0, 2).collect()}
    assert features["packet_count"].direction == "unchanged"


def random_edges(seed, n=60, nodes=7, windows=2):
    rng = np.random.default_rng(seed)
    return [
        (int(rng.integers(windows)), int(rng.integers(nodes)), int(rng.integers(nodes)), int(rng.integers(40, 900)), int(rng.integers(1, 9)), int(rng.random() < 0.3))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [0, 1])
def test_edge_removal_matches_real_removal(make_flows, seed):
    flows = make_flows(random_edges(seed))
    p = flows.toPandas()
    got = g.edge_removal(flows).toPandas()
    malicious = p[p.label == 1].groupby("window_id").size().clip(upper=5)
    assert got.groupby("window_id").size().to_dict() == malicious.to_dict() and set(got.removed_label) == {1}

    def degree_std(edges):
        nodes = sorted(set(p[p.window_id == w].src_ip) | set(p[p.window_id == w].dst_ip))
        ends = list(edges.src_ip) + list(edges.dst_ip)
        return np.std([ends.count(n) for n in nodes])

    for _, r in got.iterrows():
        w = r.window_id
        full = p[p.window_id == w]
        less = full[full.edge_idx != r.edge_idx]
        assert r.structural_impact == pytest.approx(abs(degree_std(less) - degree_std(full)) / degree_std(full), abs=1e-4)
        for f in FEATURES:
            assert r[f"{f}_delta"] == pytest.approx(less[f].mean() - full[f].mean(), abs=1e-4)


def test_edge_removal_without_malicious_edges_and_with_one_edge(make_flows):
    assert g.edge_removal(make_flows([(0, 0, 1), (0, 1, 2), (0, 2, 0)])).count() == 3
    assert g.edge_removal(make_flows([(0, 0, 1)])).count() == 0


def test_normalised_edges(make_flows):
    rows = {(r.src_ip, r.dst_ip): r for r in g.normalised_edges(make_flows([(0, 0, 1), (0, 0, 1), (0, 1, 1)])).collect()}
    # in-degree with loop: node 0 has 1, node 1 has 4
    assert rows[("0", "1")].n == 2 and rows[("0", "1")].norm == pytest.approx(0.5)
    assert rows[("1", "1")].n == 2 and rows[("1", "1")].norm == pytest.approx(0.25)


def numpy_spectrum(p):
    nodes = sorted(set(p.src_ip) | set(p.dst_ip))
    a = np.zeros((len(nodes), len(nodes)))
    for s, d in zip(p.src_ip, p.dst_ip):
        a[nodes.index(s), nodes.index(d)] += 1
    b = ((a + a.T) > 0).astype(float)
    d = 1 / np.sqrt(b.sum(1))
    return np.linalg.eigvalsh(np.eye(len(nodes)) - d[:, None] * b * d)[1], np.abs(np.linalg.eigvals(a)).max()


def test_spectral_measures_dense(make_flows, store):
    flows = make_flows(random_edges(4, 40, 6, 3))
    p = flows.toPandas()
    for r in spectral_measures(flows, store).collect():
        gap, radius = numpy_spectrum(p[p.window_id == r.window_id])
        assert r.spectral_gap == pytest.approx(gap, abs=1e-9) and r.spectral_radius == pytest.approx(radius, rel=1e-9)


SHAPES = {
    "random": random_edges(4, 30, 5, 1),
    "chain of 41 nodes": [(0, i, i + 1) for i in range(40)],
    "star": [(0, 0, i) for i in range(1, 9)],
    "two-cycle with a tail": [(0, 0, 1), (0, 1, 0), (0, 1, 0), (0, 1, 2), (0, 2, 3)],
    "ring and a parallel window": [(0, i, (i + 1) % 7) for i in range(7)] + [(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 0)],
}


def test_spectral_measures_iterated_like_dense(make_flows, store):
    """All shapes at once, each in windows of its own."""
    rows = [(10 * i + window, *ends) for i, edges in enumerate(SHAPES.values()) for window, *ends in edges]
    flows = make_flows(rows)
    dense = {r.window_id: r for r in spectral_measures(flows, store).collect()}
    iterated = {r.window_id: r for r in spectral_measures(flows, store, node_cap=0, tolerance=1e-7).collect()}
    assert dense.keys() == iterated.keys()
    for window, r in iterated.items():
        assert r.residual <= 1e-7
        assert r.spectral_gap == pytest.approx(dense[window].spectral_gap, abs=1e-6)
        assert r.spectral_radius == pytest.approx(dense[window].spectral_radius, abs=1e-6)
    for i, shape in enumerate(SHAPES):
        if shape in ("chain of 41 nodes", "star"):
            assert iterated[10 * i].spectral_radius == 0.0 == dense[10 * i].spectral_radius


def test_spectral_values_that_do_not_converge_are_null(make_flows, store):
    row = spectral_measures(make_flows(SHAPES["random"]), store, node_cap=0, max_steps=1).first()
    assert row.residual > 1e-8 and row.spectral_radius is None


def test_spectral_values_after_restarts(make_flows, store):
    """Two groups that one edge joins, a chain, a long ring with shortcuts, and cycles of nearly equal radius: what a short iteration
    does not settle. Windows of one node and of one edge have less than one basis vector to give."""
    groups = [(2, 0, 12)] + [(2, at + a, at + b) for at in (0, 12) for a in range(12) for b in range(a + 1, 12, 3)]
    loops = [(3, at + i, at + (i + 1) % n) for at, n in ((0, 9), (9, 10)) for i in range(n)]
    loops += [(3, 0, 0), (3, 9, 9), (3, 5, 2), (3, 15, 12), (3, 8, 13)]
    rows = [(0, i, i + 1) for i in range(23)] + [(1, 0, 0)] + groups + loops + [(4, 0, 1)]
    flows = make_flows(rows)
    dense = {r.window_id: r for r in spectral_measures(flows, store).collect()}
    iterated = {r.window_id: r for r in spectral_measures(flows, store, node_cap=0, basis=10).collect()}
    assert dense.keys() == iterated.keys() == set(range(5))
    for window, r in iterated.items():
        assert r.residual <= 1e-8
        assert r.spectral_gap == pytest.approx(dense[window].spectral_gap, abs=1e-7)
        assert r.spectral_radius == pytest.approx(dense[window].spectral_radius, abs=1e-6)


def test_spectral_jobs_do_not_grow_with_windows(spark, make_flows, store):
    def jobs(windows):
        spark.sparkContext.setJobGroup(f"spectral {windows}", "")
        spectral_measures(make_flows(random_edges(1, 16 * windows, 4, windows)), store, node_cap=0, max_steps=3)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"spectral {windows}"))

    assert jobs(16) <= 1.5 * jobs(1)


def test_spectral_iteration_leaves_only_its_result(make_flows, spark):
    store = Store(spark)
    store.root = store.fresh_path("spectral-test")
    rows = spectral_measures(make_flows(random_edges(2, 40, 9, 2)), store, node_cap=0, max_steps=5, basis=4).collect()
    assert len(rows) == 2
    assert [f.rsplit("-", 1)[0] for f in os.listdir(store.root)] == ["large_spectra"]
    with pytest.raises(ValueError):
        store.clear()


def test_both_ends_of_an_edge_are_one_pass(spark):
    """Edges that come from a join are worked out once, not once per end."""
    left = spark.range(4).selectExpr("id AS k", "0 AS window_id", "'a' AS src_ip", "1 AS packet_count", "2 AS total_bytes", "1 AS label")
    edges = left.join(spark.range(4).selectExpr("id AS k", "concat('b', id) AS dst_ip"), "k")
    nodes = g.node_features(edges)
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r.ip: (r.bytes_sent, r.bytes_recv, r.out_degree, r.in_degree, r.malicious_out) for r in nodes.collect()}
    assert got == {"a": (8, 0, 4, 0, 4), **{f"b{i}": (0, 2, 0, 1, 0) for i in range(4)}}


def test_loops_meet_no_join_of_all_edges(spark):
    """Edges of a node to itself add to its loop, and loops do not go through the joins of the edges."""
    flows = spark.createDataFrame(
        [(0, "a", "a"), (0, "a", "a"), (0, "a", "b"), (0, None, "b")], "window_id int, src_ip string, dst_ip string"
    ).selectExpr("*", "1 AS packet_count", "1 AS total_bytes", "0 AS label")
    out = g.normalised_edges(flows)
    got = {(r.src_ip, r.dst_ip): (r.n, round(r.norm, 9)) for r in out.collect()}
    assert got == {("a", "a"): (3, round(1 / 3, 9)), ("b", "b"): (1, round(1 / 3, 9)), ("a", "b"): (1, round(1 / 3, 9))}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
