import pytest

from packetloom.operators import incidents as inc
from packetloom.operators import search as se
from packetloom.operators import textsearch as ts


@pytest.fixture(scope="module")
def flows(spark):
    rows = [(f"f{i:02d}", float(i // 3), "abc"[i % 3], "bcd"[i % 3], 10 * i, 500 * i, i % 2, i / 20, int(i >= 10)) for i in range(20)]
    return spark.createDataFrame(
        rows,
        "flow_id string, window_start double, src_ip string, dst_ip string, packet_count long, total_bytes long,"
        " label int, prediction_score double, prediction int",
    )


def ids(df):
    return [r.flow_id for r in df.collect()]


def test_combined_filters(flows):
    got = se.search_flows(flows, se.flow_clauses(label=1, src_ip="b", min_packet_count=70))
    assert ids(got) == ["f07", "f13", "f19"]


def test_filters_are_checked(flows):
    with pytest.raises(ValueError, match="Unknown column"):
        se.where_all(flows, [("script", "==", 1)])
    with pytest.raises(ValueError, match="not allowed"):
        se.where_all(flows, [("label", "script", 1)])


def test_anomalous_flows(flows):
    assert ids(se.search_anomalous_flows(flows, 0.85, 2)) == ["f19", "f18"]


def test_pages_cover_everything_once(flows):
    seen, after = [], None
    while True:
        rows = se.page(flows, 6, after).collect()
        if not rows:
            break
        assert {r.total for r in rows} == {20}
        seen += [(-r.window_start, r.flow_id) for r in rows]
        after = (rows[-1].window_start, rows[-1].flow_id)
    assert seen == sorted(seen) and len(seen) == 20


def test_explain(flows):
    row = se.explain_match(flows, [("label", "==", 1), ("src_ip", "in", ["a"])]).where("flow_id = 'f01'").first()
    assert not row.matched and [c.ok for c in row.clauses] == [True, False]


def test_severity_search(flows):
    assert ids(se.search_by_severity(flows, "critical", 5)) == ["f19"]
    assert ids(se.search_by_severity(flows, size=2)) == ["f19", "f18"]


def test_related_flows(flows):
    one = flows.where("flow_id = 'f00'")  # a -> b
    got = inc.sharing_an_address(flows, one)
    assert sorted(ids(got)) == sorted(ids(flows.where("src_ip in ('a', 'b') or dst_ip in ('a', 'b')")))


def test_unknown_incident_shows_all_malicious_flows(flows):
    assert inc.incident_flows(flows, "nobody").count() == 10


def test_incident_form(flows):
    row = inc.incident(flows, "f19").first()
    assert row.title == "b → c" and row.severity == "critical"
    assert row.description == "190 packets with 9500 bytes, scored 95 of 100"
    assert row.affected_systems == ["b", "c"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "High packet count, high packet rate"), (2, "low paket count"), (3, "nothing here"), (4, "PACKETS!")]
    return spark.createDataFrame(rows, "id long, text string")


def test_text_search_ranks_and_forgives(texts):
    got = ts.search_text(texts, "packet", "id", "text").collect()
    # a short text counts more than a long one, an exact word more than a near one
    assert [r.id for r in got] == [4, 1, 2]
    assert {r.id for r in ts.search_text(texts, "packet", "id", "text", fuzzy=False).collect()} == {1}
    assert ts.search_text(texts, "zzzzzz", "id", "text").count() == 0


def test_bm25_value(texts):
    import math

    (row,) = ts.search_text(texts, "packet", "id", "text", fuzzy=False).collect()
    idf = math.log(1 + (4 - 1 + 0.5) / (1 + 0.5))
    tf, length, mean = 2, 6, (6 + 3 + 2 + 1) / 4
    assert row.score == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), abs=1e-6)


def test_highlights(texts):
    found = ts.search_text(texts, "packet", "id", "text")
    rows = {r.id: r.highlight for r in ts.with_highlights(found, texts, "id", "text").collect()}
    assert rows[1] == "High <em>packet</em> count, high <em>packet</em> rate"
    assert rows[4] == "<em>PACKETS</em>!"


def test_edit_limits():
    assert [ts.allowed_edits(w) for w in ("ab", "abc", "abcde", "abcdef")] == [0, 1, 1, 2]
