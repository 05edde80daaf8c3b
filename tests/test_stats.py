import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.functions import cleaning as cl
from packetloom.functions.severity import severity_of_score, severity_of_z, with_severity
from packetloom.operators import anomalies as an
from packetloom.operators import stats
from packetloom.schemas import FEATURES


def labels(spark, values):
    return spark.createDataFrame([(v,) for v in values], "label int")


@pytest.mark.parametrize(
    "values,want",
    [([0, 1, 0, 1], {0: 1.0, 1: 1.0}), ([0, 0, 0, 1], {0: 4 / 6, 1: 2.0}), ([0, 0], {0: 3 / 2, 1: 3.0}), ([], {0: 1.0, 1: 1.0})],
)
def test_class_weights(spark, values, want):
    got = {r.label: r.weight for r in stats.class_weights(labels(spark, values)).collect()}
    assert got == pytest.approx(want)


def test_positive_weight_without_positives(spark):
    assert stats.positive_weight(labels(spark, [0, 0, 0])).first().pos_weight == 3.0


def test_percentiles_match_numpy(spark, store):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"label": rng.integers(0, 2, 501), "a": rng.integers(0, 9, 501).astype(float), "b": rng.normal(size=501)})
    got = stats.percentiles(spark.createDataFrame(p), ["a", "b"], store, [0, 5, 33, 50, 99, 100]).collect()
    assert len(got) == 24
    for r in got:
        assert r.value == pytest.approx(np.percentile(p[p.label == r.label][r.feature], r.percent))


def test_percentile_of_one_value(spark, store):
    df = spark.createDataFrame([(0, 4.0)], "label int, a double")
    assert {r.value for r in stats.percentiles(df, ["a"], store).collect()} == {4.0}


def test_constant_feature_normalises_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "a double, b double")
    rows = stats.normalise(df, ["a", "b"]).collect()
    assert {r.a for r in rows} == {0.0} and sorted(r.b for r in rows) == [-1.0, 1.0]


def test_finite_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1.5,)], "x double")
    assert [r.x for r in cl.nonfinite_to_null(df).collect()] == [None, None, None, None, 1.5]
    assert [r.x for r in cl.nonfinite_to_zero(df, ["x"]).collect()] == [0.0, 0.0, 0.0, 0.0, 1.5]
    mixed = spark.createDataFrame([(1, True, "a")], "i int, b boolean, s string")
    assert cl.nonfinite_to_null(mixed).collect() == mixed.collect()


def test_safe_numbers(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,), ("7.5",)], "s string")
    assert [r[0] for r in df.select(cl.safe_int("s")).collect()] == [7, 0, 0, 0]
    assert [r[0] for r in df.select(cl.safe_float("s")).collect()] == [7.0, 0.0, 0.0, 7.5]
    nums = spark.createDataFrame([(3.9,), (float("nan"),)], "x double")
    assert [r[0] for r in nums.select(cl.safe_int("x", 5)).collect()] == [3, 5]


def test_timestamp_units(spark):
    df = spark.createDataFrame([(1.7e15,), (1.7e12,), (1.7e9,)], "t double")
    assert [r[0] for r in df.select(cl.epoch_seconds("t")).collect()] == [1.7e9] * 3


def test_default_event_time(spark):
    df = spark.createDataFrame([(None, 1.0), (10.0, float("nan"))], "timestamp double, packet_count double")
    rows = cl.clean_flow_documents(df, ["packet_count", "std_iat"]).collect()
    assert all(r.event_time is not None for r in rows) and rows[1].packet_count == 0.0


def test_severity_limits(spark):
    df = spark.createDataFrame([(0.9,), (0.91,), (0.7,), (0.5,), (0.51,)], "s double")
    assert [r[0] for r in df.select(severity_of_score(F.col("s"))).collect()] == ["high", "critical", "medium", "low", "medium"]
    df = spark.createDataFrame([(5.0,), (3.0,), (1.5,), (1.49,)], "s double")
    assert [r[0] for r in df.select(severity_of_z(F.col("s"))).collect()] == ["critical", "high", "medium", "low"]


def test_missing_scores(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 0, 200000)], "prediction_score double, label int, total_bytes long")
    a, b = with_severity(df).collect()
    assert (a.severity_level, a.severity_score, a.traffic_volume_category) == ("high", 0.85, "low")
    assert (b.severity_level, b.severity_score, b.traffic_volume_category) == ("low", 0.2, "flood")


def test_stats_detection_without_normal_flows_returns_all(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 1)], "flow_id string, label int, packet_count long")
    assert an.detect_anomalies(df, "stats").count() == 2


def test_anomaly_records_find_the_burst(spark):
    rows = [("s", float(60 * i), 10 + i % 2, 500, "d", 6) for i in range(20)] + [("s", 1200.0, 500, 500, "x", 17)]
    flows = spark.createDataFrame(rows, "src_ip string, window_start double, packet_count long, total_bytes long, dst_ip string, protocol int")
    hits = an.anomaly_records(flows, 60.0).collect()
    assert [(r.src_ip, r.bucket, r.detector) for r in hits] == [("s", 20, "high_count")]
    who = {(r.field, r.value) for r in an.influencers(flows, 60.0).collect()}
    assert who == {("src_ip", "s"), ("dst_ip", "x"), ("protocol", "17")}


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.1, 1), (0.2, 0), (None, 1)], "prediction_score double, label int")
    m = stats.classification_metrics(df).first()
    assert (m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5)
    empty = stats.classification_metrics(df.where("label = 0 and prediction_score < 0.5")).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_bucket_fields_are_checked(spark):
    with pytest.raises(ValueError, match="not allowed"):
        stats.bucket_counts(labels(spark, [1]), "window_id")


def test_severity_assessment_skips_missing_values(spark):
    columns = ", ".join(f"{f} double" for f in FEATURES)
    rows = [(0, *[1.0] * 5), (0, *[3.0] * 5), (1, 12.0, None, None, None, None), (1, *[None] * 5)]
    got = an.assess_severity(spark.createDataFrame(rows, f"label int, {columns}")).collect()
    assert [(r.max_z_score, r.severity) for r in got[2:]] == [(10.0, "critical"), (0.0, "low")]


def test_class_weights_with_a_given_number_of_classes(spark):
    """Only labels there are have a row, also where one is missing."""
    for values, want in (([1, 1], {1: 0.5}), ([0, 1, 1, 1], {0: 2.0, 1: 4 / 6})):
        got = {r.label: r.weight for r in stats.class_weights(labels(spark, values), classes=2).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("values,want", [([1, 1], {1: 1.0}), ([0, 0], {0: 1.0}), ([0, 0, 0, 1], {0: 1.0, 1: 3.0})])
def test_rows_of_one_class_keep_their_weight(spark, values, want):
    rows = labels(spark, values)
    assert dict(map(tuple, rows.select("label", stats.balanced_weight(rows)).distinct().collect())) == want
