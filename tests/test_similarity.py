import numpy as np
import pytest

from packetloom.operators import similarity as si


def vectors(spark, ids, matrix):
    rows = [(str(i), [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, "flow_id string, embedding array<double>")


def brute(q_ids, q, b_ids, b, k, skip_self=False):
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    b = b / np.linalg.norm(b, axis=1, keepdims=True)
    sims = np.round(q @ b.T, 6)
    out = set()
    for i, row in zip(q_ids, sims):
        order = sorted((-s, str(j)) for s, j in zip(row, b_ids) if not (skip_self and str(i) == str(j)))
        out |= {(str(i), j, -s, r + 1) for r, (s, j) in enumerate(order[:k])}
    return out


def data(seed, n, dim, copies):
    """A third of all rows are copies of one vector."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[rng.random(n) < copies] = m[0]
    return m


@pytest.mark.parametrize(
    "options",
    [{}, {"broadcast_values": 0, "cells": 6, "block_rows": 16}, {"broadcast_values": 0, "cells": 1, "block_rows": 5}],
)
@pytest.mark.parametrize("dim", [3, 16])
def test_nearest_is_exact(spark, store, options, dim):
    q, b = data(1, 40, dim, 0.3), data(2, 150, dim, 0.35)
    q[:5] = b[:5]
    got = si.nearest(vectors(spark, range(40), q), vectors(spark, range(1000, 1150), b), store, 4, **options)
    rows = {(r["query"], r.neighbour, r.similarity, r["rank"]) for r in got.collect()}
    want = brute(range(40), q, range(1000, 1150), b, 4)
    assert {r[:2] + r[3:] for r in rows} == {r[:2] + r[3:] for r in want}
    assert sorted(r[2] for r in rows) == pytest.approx(sorted(r[2] for r in want), abs=2e-6)


@pytest.mark.parametrize("options", [{}, {"broadcast_values": 0, "cells": 4, "block_rows": 8}])
def test_self_is_left_out_on_request(spark, store, options):
    m = data(3, 50, 8, 0.3)
    v = vectors(spark, range(50), m)
    got = si.nearest(v, v, store, 3, exclude_self=True, **options)
    assert {(r["query"], r.neighbour) for r in got.collect()} == {r[:2] for r in brute(range(50), m, range(50), m, 3, True)}


def test_fewer_base_rows_than_k(spark, store):
    m = data(4, 3, 4, 0)
    for options in ({}, {"broadcast_values": 0, "cells": 2}):
        got = si.nearest(vectors(spark, range(3), m), vectors(spark, range(2), m[:2]), store, 5, **options)
        assert got.count() == 6


def test_no_base_rows(spark, store):
    m = data(4, 3, 4, 0)
    v = vectors(spark, range(3), m)
    assert si.nearest(v, v.limit(0), store, 2).count() == 0


def test_vectors_without_cells_are_compared_in_a_grid(spark, store, monkeypatch):
    """Random vectors are all about equally far apart, so bounds exclude next to nothing; no task may hold all of them."""
    seen = []
    monkeypatch.setattr(si, "_GRID_ROWS", (40, 80))
    grid = si._grid_search
    monkeypatch.setattr(si, "_grid_search", lambda *a: seen.append(a[3:]) or grid(*a))
    q, b = data(5, 130, 32, 0), data(6, 300, 32, 0.1)
    got = si.nearest(vectors(spark, range(130), q), vectors(spark, range(1000, 1300), b), store, 4, broadcast_values=0, cells=8, block_rows=4)
    assert {(r["query"], r.neighbour, r["rank"]) for r in got.collect()} == {r[:2] + r[3:] for r in brute(range(130), q, range(1000, 1300), b, 4)}
    assert len(seen) == 1


def test_projection_has_unit_columns():
    assert np.allclose(np.linalg.norm(si.projection(), axis=0), 1)


def test_differences(spark):
    fields = "packet_count double, total_bytes double, mean_payload double, mean_iat double, std_iat double"
    a, b = (10.0, 0.0, 4.0, None, 1.0), (5.0, 3.0, 4.0, 1.0, 2.0)
    df = spark.createDataFrame([(a, b)], f"a struct<{fields}>, b struct<{fields}>")
    (diffs,) = df.select(si.feature_differences()).first()
    got = [(d.feature, d.pct_change, d.direction) for d in diffs]
    assert got == [
        ("total_bytes", 99999.99, "increase"),
        ("std_iat", 100.0, "increase"),
        ("packet_count", 50.0, "decrease"),
        ("mean_payload", 0.0, "unchanged"),
    ]


def test_wrong_dimension(spark):
    df = vectors(spark, "ab", [[1, 2], [1, 2]]).unionByName(vectors(spark, "c", [[1]]))
    assert [r.flow_id for r in si.wrong_dimension(df, 2).collect()] == ["c"]
