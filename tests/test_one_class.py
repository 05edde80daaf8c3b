"""Jobs over flows that are all malicious, as where windows are so full that each flow has a bad packet."""

import pytest

from packetloom.operators import scoring as sc
from packetloom.operators.flows import sliding_flows, with_flow_ids
from packetloom.plans import batch


@pytest.fixture(scope="module")
def packets(make_packets):
    return make_packets([(t / 2, f"a{t % 3}", f"b{t % 2}", 100 + t, 1) for t in range(60)])


def test_classifier_of_one_class(spark, store, packets):
    flows = with_flow_ids(sliding_flows(packets, 2.0, 1.0), store)
    model, metrics = sc.train_edge_classifier(flows, store)
    got = {r.split: (r.fp, r.fn, r.recall) for r in metrics.collect()}
    assert got == {s: (0, 0, 1.0) for s in ("train", "val", "test")}
    scores = sc.classifier_scorer(model, sc.Scaling.fit(flows))(flows)
    assert {r.prediction for r in scores.collect()} == {1}


def test_ingest_has_a_row_for_every_malicious_flow(store, packets):
    result = batch.ingest(packets, store)
    rows = result.counterfactuals.collect()
    assert len(rows) == result.flows.count() > 0
    assert {r.nearest_normal_id for r in rows} == {None} and all("no normal flow" in r.explanation_text for r in rows)
