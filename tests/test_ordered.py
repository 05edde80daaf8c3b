import numpy as np
import pandas as pd

from packetloom.operators import ordered as od


def hot_frame(spark, n=3000):
    rng = np.random.default_rng(5)
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 20, n))
    return spark.createDataFrame(pd.DataFrame({"g": g, "k": rng.permutation(n), "w": rng.integers(1, 9, n)}))


def test_rank_within_a_hot_group(spark, store):
    got = od.rank_within(hot_frame(spark), ["g"], ["k"], store).toPandas().sort_values(["g", "k"])
    assert (got.row_idx.to_numpy() == got.groupby("g").cumcount().to_numpy()).all()
    assert len(got) == 3000


def test_running_total(spark, store):
    got = od.running_total(hot_frame(spark), ["g"], ["k"], "w", store, "upto").toPandas().sort_values(["g", "k"])
    assert (got.upto.to_numpy() == got.groupby("g").w.cumsum().to_numpy()).all()


def test_previous_value(spark, store):
    got = od.previous_value(hot_frame(spark), ["k"], "w", store, "before").toPandas().sort_values("k")
    want = got.w.shift(1)
    assert np.isnan(got.before.iloc[0]) and (got.before.iloc[1:] == want.iloc[1:]).all()


def test_rank_integers(spark):
    df = spark.range(500).selectExpr("id * 13 - 700 as k", "id % 2 = 0 as even")
    got = od.rank_integers(df, "k", "r", bucket=50).toPandas().sort_values("k")
    assert got.r.tolist() == list(range(500))
    by = od.rank_integers(df, "k", "r", ["even"], bucket=50).toPandas().sort_values(["even", "k"])
    assert by.r.tolist() == list(range(250)) * 2
