"""Top products and clusters of integer vectors, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from packetloom.llm import shallot, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, clash=True):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for name in ("v", "q", "h", "copy", "block", "list", "ids", "near", "score", "rank", "cluster") if clash else ():
        df = df.withColumn(name, df["label"])
    return df


def kept(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def ints(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


def brute_top(rows, every=20, k=20):
    by_id = {}
    for i, v in kept(rows):
        if i is not None:
            v = ints(v, 64)
            by_id[i] = min(v, by_id.get(i, v))
    out = []
    for q, a in by_id.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in by_id.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def odd_vectors(n=400, width=6, seed=3):
    """Ties, copies up to a third of the rows, nulls, infinities, other lengths, large components, repeated rows."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.5, -0.02, 0.0, 0.01, 0.5)) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, [0.5] * width) for i in range(n // 2)]
    rows += [(5000, None), (5020, [None] * width), (5040, [float("nan")] * width), (5041, [float("inf")] + [0.0] * (width - 1))]
    rows += [(6000, []), (6001, [0.25] * (width + 3)), (6020, [1.5] * (width - 1)), (7000, [3000.0] * width), (-20, [-0.25] * width)]
    return rows + [(None, [0.5] * width), (None, [0.1] * width), (0, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors(30), [(20, [0.5]), (40, [0.5])], [(20, [0.5, 0.25])], [(20, []), (21, [])]])
def test_top_products(spark, store, rows):
    got = topk.top_products(frame(spark, rows), store)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_top_products_over_many_blocks(spark, store, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(900, 9)).round(1).tolist())]
    assert sorted(map(tuple, topk.top_products(frame(spark, rows), store).collect())) == brute_top(rows)


def test_cutoffs_leave_most_entries_where_they_are(spark, store, monkeypatch):
    sizes = []
    save = type(store).save

    def saved(self, df, name, partition_by=None):
        out = save(self, df, name, partition_by)
        if name in ("candidates", "possible"):
            sizes.append((name, sum(len(vectors.unpack(r["at"])) for r in out.select("at").collect())))
        return out

    monkeypatch.setattr(type(store), "save", saved)
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(4000, 32)).tolist())]
    assert sorted(map(tuple, topk.top_products(frame(spark, rows), store).collect())) == brute_top(rows)
    found = dict(sizes)
    assert found["possible"] < found["candidates"] < 200 * 4000 / 4


def test_exact_product_of_large_numbers():
    a = np.array([[vectors.LARGEST, -vectors.LARGEST], [1, 2]])
    assert vectors.exact_product(a, a).tolist() == [[2 * vectors.LARGEST**2, -vectors.LARGEST], [-vectors.LARGEST, 5]]


@pytest.mark.parametrize("values", [[], [0], [127, -128], [128], [-129], [1 << 40, -(1 << 62)]])
def test_packed_integers(values):
    assert vectors.unpack(vectors.pack(np.array(values, np.int64))).tolist() == values


def brute_clusters(rows, k, rounds=5, width=6):
    fit = [(i, ints(v, 256)) for i, v in kept(rows) if len(v) == width]
    fit = [(i, [max(min(x, vectors.LARGEST), -vectors.LARGEST) for x in v]) for i, v in fit]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in fit if i is not None)
    centroids = [v for _, _, v in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in fit]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, n) in zip(fit, near) if n == j]
            if members:
                centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    near = assign()
    inertia = [sum(d for d, n in near if n == j) for j in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = [(i, n, d, inertia[n], sum(inertia), digests[n]) for (i, _), (d, n) in zip(fit, near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 2, 7, 40])
@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors(5), [(1, [0.5] * 6)], [(i, [0.5] * 6) for i in range(50)]])
def test_clusters(spark, store, rows, k):
    rows = [r for r in rows if r[0] != 7000]
    got = shallot.cluster(frame(spark, rows), store, k=k, width=6)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, k)


def test_clusters_with_structure(spark, store, monkeypatch):
    monkeypatch.setattr(shallot, "ROWS", 100)
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 6)) * 4
    rows = [(i, (middles[i % 12] + rng.normal(size=6) * 0.2).tolist()) for i in range(1500)]
    got = shallot.cluster(frame(spark, rows), store, k=12, width=6)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 12)


def test_the_bounds_spare_searches_and_the_ball_spares_centroids():
    rng = np.random.default_rng(6)
    middles = (rng.normal(size=(20, 6)) * 4000).astype(np.int64)
    x = middles[np.arange(2000) % 20] + rng.integers(-40, 40, (2000, 6))
    c = shallot.Centroids(middles, np.zeros(20))
    near, second, d1, d2 = shallot.search(x, np.zeros(2000, np.int64), np.ones(2000, np.int64), c)
    d = ((x[:, None] - middles[None]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")
    assert (near == order[:, 0]).all() and (second == order[:, 1]).all()
    assert (d1 == d.min(1)).all() and (d2 == np.sort(d, axis=1)[:, 1]).all()


def test_empty_tables(spark, store):
    assert topk.top_products(frame(spark, []), store).count() == 0
    empty = shallot.cluster(frame(spark, []), store)
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
