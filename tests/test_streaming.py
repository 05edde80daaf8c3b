import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.schemas import PACKETS
from packetloom.streaming import events as ev
from packetloom.streaming import packets as st


@pytest.fixture()
def files(spark, make_packets, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(round(t, 3), f"h{rng.integers(3)}", f"h{rng.integers(3)}", int(rng.integers(90)), int(rng.random() < 0.6)) for t in np.sort(rng.uniform(0, 40, 120))]
    packets = make_packets(rows)
    have = set(packets.columns)
    full = packets.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in PACKETS.fields])
    source = str(tmp_path / "in")
    for i, cut in enumerate([(0, 13), (13, 22), (22, 41)]):
        part = full.where((F.col("timestamp") >= cut[0]) & (F.col("timestamp") < cut[1]))
        part.coalesce(1).write.mode("append").json(source)
    return full, source


def label_scores(flows):
    return flows.withColumn("prediction_score", F.col("label").cast("double")).withColumn("prediction", F.col("label"))


def test_stream_equals_batch(spark, files, tmp_path):
    full, source = files
    out = st.StreamTables(str(tmp_path / "out"))
    run = lambda: st.run_available(spark, st.packet_stream(spark, source), out, label_scores, 5.0, 1.5, "1 hour", 0.6)
    run()
    batch = st.window_flows(st.with_event_time(full), 5.0, 1.5)
    columns = ["window_id", "window_start", *st.FIVE_TUPLE, "packet_count", "total_bytes", "label", "flow_id", F.round("std_iat", 9)]
    got = out.read(spark, "flows", batch.schema, ["window_id", "flow_id"])
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert key(got) == key(batch)
    results = {r.window_id: r for r in out.read(spark, "results", st.RESULTS, ["window_id"]).collect()}
    per_window = batch.groupBy("window_id").agg(F.count("*").alias("n"), F.avg("label").alias("s")).collect()
    assert {w: (r.num_flows, r.anomaly_score) for w, r in results.items()} == {r.window_id: (r.n, pytest.approx(r.s)) for r in per_window}
    alerts = {r.window_id for r in st.active_alerts(spark, out).collect()}
    assert {w for w, r in results.items() if r.anomaly_score >= 0.6} == alerts
    before = key(got)
    run()  # nothing new: the run starts where it stopped
    assert key(out.read(spark, "flows", batch.schema, ["window_id", "flow_id"])) == before


def test_windows_are_anchored_and_gaps_stay_empty(spark, make_packets):
    flows = st.window_flows(st.with_event_time(make_packets([(10.2, "a", "b"), (30.1, "a", "b")])), 5.0, 10.0)
    assert sorted((r.window_id, r.window_start) for r in flows.collect()) == [(0, 10.0), (4, 30.0)]


def test_label_of_the_first_packet(spark, make_packets):
    rows = [(1, "a", "b", 5, 1), (2, "a", "b", 5, 0)]
    packets = make_packets(rows).withColumn("src_port", F.lit(7))
    (flow,) = st.window_flows(st.with_event_time(packets), 5.0).collect()
    assert flow.label == 1 and flow.packet_count == 2 and flow.mean_iat == 0.5


def test_missing_parts_of_a_packet(spark, make_packets):
    packets = make_packets([(1, None, "b")]).withColumn("src_port", F.lit(None).cast("int"))
    (flow,) = st.window_flows(st.with_event_time(packets), 5.0).collect()
    assert (flow.src_ip, flow.src_port) == ("0.0.0.0", 0)


def by_hand(rows, size):
    """Deviation of the gaps of each (window, source, destination); the first gap is 0."""
    flows = {}
    for t, src, dst, *_ in sorted(rows):
        flows.setdefault((int(t // size), src, dst), []).append(t)
    return {k: float(np.std([0.0, *np.diff(v)], ddof=1)) if len(v) > 1 else 0.0 for k, v in flows.items()}


@pytest.mark.parametrize("files_per_batch", [1, 4])
def test_gap_deviation_of_packets_that_come_late_and_over_a_restart(spark, make_packets, tmp_path, files_per_batch):
    """Each file holds packets of all times, so most packets come after later ones; equal instants and a flood are among them."""
    rng = np.random.default_rng(3)
    rows = [(round(t, 2), f"h{rng.integers(2)}", f"h{rng.integers(2)}") for t in rng.uniform(0, 20, 300)]
    rows += [(7.0, "h0", "h1")] * 5 + [(7 + i / 1000, "flood", "h1") for i in range(400)]
    have = make_packets(rows).withColumn("src_port", F.lit(1))
    full = have.select(*[F.col(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PACKETS.fields])
    source, out = str(tmp_path / "in"), st.StreamTables(str(tmp_path / "out"))
    for half in (0, 1):
        for part in (0, 1, 2):
            full.where(f"packet_index % 2 = {half} and packet_index % 3 = {part}").coalesce(1).write.mode("append").json(source)
        st.run_available(spark, st.packet_stream(spark, source, files_per_batch), out, label_scores, 5.0, 0.0, "1 hour")
    schema = st.window_flows(st.with_event_time(full), 5.0).schema
    got = {(r.window_id, r.src_ip, r.dst_ip): r.std_iat for r in out.read(spark, "flows", schema, ["window_id", "flow_id"]).collect()}
    assert got == pytest.approx(by_hand(rows, 5.0), abs=1e-6)


@pytest.mark.parametrize("size_us, parts", [(5_000_000, 16), (7, 7), (11, 11), (17, 1), (1, 1)])
def test_slices_fill_a_window(size_us, parts):
    assert st._slice_length(size_us) * parts == size_us


def test_labels_of_tables(spark, make_packets):
    packets = st.with_event_time(make_packets([(float(t), "a", "b") for t in range(4)]))
    labels = spark.createDataFrame([(0, 1, 0.0), (1, 1, 12.0), (2, 1, 1.0), (None, 1, 1.0), (3, 1, None)], ev.LABEL_EVENTS)
    got = ev.join_labels(packets, ev.with_label_time(labels), "10 seconds", None)
    # in time; too late; before its packet; without a time
    assert [r.label for r in got.orderBy("packet_index").collect()] == [1, 0, 0, 0]


def test_bursts_of_a_source(spark, make_packets):
    packets = st.with_event_time(make_packets([(0, "a", "b"), (5, "a", "b"), (16, "a", "b"), (3, "c", "b"), (3, "c", "b")]))
    got = ev.bursts(packets, "10 seconds", None).select("src_ip", "started", "ended", "packets")
    assert sorted(map(tuple, got.collect())) == [("a", 0.0, 5.0, 2), ("a", 16.0, 16.0, 1), ("c", 3.0, 3.0, 2)]


def test_panes_spare_the_state_the_overlap(spark, files, tmp_path):
    """Windows over eight panes: the first step holds a row per pane and flow, as if there were no overlap."""
    full, source = files
    rows = ev.sliding_counts(st.packet_stream(spark, source, 10), 8.0, 1.0, 0.0, "1 hour")
    done = ev.run_to_end(rows, str(tmp_path / "out"), str(tmp_path / "progress"))
    held = [p for p in done.recentProgress if p.numInputRows][-1].stateOperators
    panes = full.groupBy(F.floor("timestamp"), "src_ip", "dst_ip", "protocol", "dst_port").count().count()
    assert max(s.numRowsTotal for s in held) == panes
    table = ev.sliding_counts(st.with_event_time(full), 8.0, 1.0, 0.0, None)
    want = full.crossJoin(spark.range(-7, 41).withColumnRenamed("id", "w")).where("timestamp >= w and timestamp < w + 8")
    want = want.groupBy("w", "src_ip", "dst_ip", "protocol", "dst_port").agg(F.count("*").alias("n"), F.sum("packet_length").alias("b"))
    columns = ["window_id", "src_ip", "dst_ip", "protocol", "dst_port", "packet_count", "total_bytes"]
    assert sorted(map(tuple, table.select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_progress_rows(spark, files, tmp_path):
    full, source = files
    log = ev.ProgressLog(spark, str(tmp_path / "log"))
    with log:
        packets = ev.observed(st.packet_stream(spark, source))
        st.run_available(spark, packets, st.StreamTables(str(tmp_path / "out")), label_scores, 5.0)
    rows = {r.batch_id: r for r in log.read().collect()}
    assert sum(r.input_rows for r in rows.values()) == sum(r.observed_rows for r in rows.values()) == full.count()
    assert len(rows) >= 3 and all(r.milliseconds >= 0 for r in rows.values())


def test_state_has_rows_of_fixed_width_and_flows_need_no_sort_aggregate(spark, files, tmp_path):
    """Neither the state of a flow nor the newest rows grow into one large value."""
    full, source = files
    instants = st.flow_instants(st.with_event_time(full), 5.0, watermark=None)
    wide = [f.name for f in instants.schema if f.dataType.typeName() in ("array", "map", "struct", "binary")]
    plan = st.join_instants(st.newest_instants(instants.withColumn("batch_id", F.lit(0).cast("long"))))._jdf.queryExecution().toString()
    assert not wide and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_flows_are_those_of_the_last_batch_of_their_window(spark, files, tmp_path):
    full, source = files
    out = st.StreamTables(str(tmp_path / "out"))
    st.run_available(spark, st.packet_stream(spark, source), out, label_scores, 5.0)
    assert spark.conf.get(st.STATE_PROVIDER, st.HEAP_STORE) == st.HEAP_STORE
    batch = st.window_flows(st.with_event_time(full), 5.0)
    got = st.newest_per_window(spark, out, "flows", batch.schema)
    key = lambda df: sorted(map(tuple, df.select(*batch.columns[:9], "label", "flow_id").collect()))
    assert key(got) == key(batch)
    (metadata,) = {line for p in (tmp_path / "out" / "_progress" / "offsets").glob("0") for line in p.read_text().splitlines() if "providerClass" in line}
    assert "RocksDB" in metadata
