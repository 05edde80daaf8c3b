import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import neighbours as nb
from packetloom.operators.similarity import nearest


def vectors(spark, n, width=8, clusters=40, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, width))
    rows = [(f"v{i:05d}", (middles[i % clusters] + 0.3 * rng.normal(size=width)).tolist()) for i in range(n)]
    rows += [(f"w{i:05d}", rows[0][1]) for i in range(copies)]
    return spark.createDataFrame(rows, "flow_id string, embedding array<double>").withColumn("bucket", F.lit(1))


def test_most_neighbours_are_found_in_a_part_of_the_buckets(spark, store):
    base = vectors(spark, 6000, copies=2000)  # a quarter are copies of one vector
    index = nb.NeighbourIndex(spark, store.fresh_path("ann")).fit(base)
    index.add(base.where("flow_id < 'v03000'"), 0)
    index.add(base.where("flow_id >= 'v03000'"), 1)
    queries = base.where("flow_id like '%7'")
    row = nb.measured(index, queries, base, store, 5, exclude_self=True).first()
    assert row.queries == queries.count() and row.share >= 0.9
    directions, _ = index.shape()
    assert directions.shape[1] >= 5 and index.probes + 1 < 2 ** directions.shape[1] / 4


def test_all_probes_give_the_exact_answer(spark, store, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 16)
    base = vectors(spark, 300, copies=30)
    index = nb.NeighbourIndex(spark, store.fresh_path("ann"), tables=2, probes=3).fit(base)
    assert index.shape()[0].shape[1] == 2  # four buckets, all of which are looked into
    index.add(base, 0)
    got = index.search(base, 4, exclude_self=True)
    want = nearest(base, base, store, 4, exclude_self=True)
    key = lambda df: sorted(map(tuple, df.select("query", "rank", "neighbour", "similarity").collect()))
    assert key(got) == key(want)


@pytest.mark.parametrize("bits, probes", [(2, 3), (5, 8), (12, 40)])
def test_flips(bits, probes):
    masks = nb.flips(bits, probes)
    assert not masks[0].any() and len(np.unique(masks, axis=0)) == len(masks) == min(probes + 1, 2**bits)
    assert masks[1].tolist() == [True] + [False] * (bits - 1)  # the most doubtful bit first


def test_an_empty_index(spark, store):
    base = vectors(spark, 0)
    index = nb.NeighbourIndex(spark, store.fresh_path("ann")).fit(base)
    index.add(base, 0)
    assert index.search(vectors(spark, 3), 2).count() == 0


def test_probes_are_raised_until_neighbours_without_clusters_are_found(spark, store):
    """Vectors of 32 independent numbers have their neighbours all over the buckets."""
    base = vectors(spark, 4000, width=32, clusters=1)
    index = nb.NeighbourIndex(spark, store.fresh_path("ann"), tables=4, probes=1).fit(base)
    index.add(base, 0)
    row = nb.measured(index, base.where("flow_id like '%37'"), base, store, 10, exclude_self=True).first()
    assert row.queries == 40 and row.share >= 0.9


def test_blocks_are_never_broadcast(spark, store):
    """A row of arrays may hold a thousand vectors, which Spark's estimate does not know."""
    base = vectors(spark, 300)
    index = nb.NeighbourIndex(spark, store.fresh_path("ann")).fit(base)
    index.add(base, 0)
    plan = index.search(base, 4)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas") :]  # the first one compares
    assert "SortMergeJoin [tab" in below and "BroadcastHashJoin [tab" not in plan


def test_queries_without_neighbours_are_asked_and_miss_nothing(spark, store):
    """As where every flow is malicious and none is normal."""
    base = vectors(spark, 0)
    index = nb.NeighbourIndex(spark, store.fresh_path("ann")).fit(base)
    index.add(base, 0)
    row = nb.measured(index, vectors(spark, 3), base, store, 2).first()
    assert (row.queries, row.wanted, row.share) == (3, 0, 1.0)
