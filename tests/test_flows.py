import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows as fl
from packetloom.operators import windows as win


def brute_starts(t, size, stride):
    starts = np.arange(t.min(), t.max() - size + 1e-9, stride)
    return starts if len(starts) else np.array([t.min()])


def brute_pairs(t, size, stride):
    starts = brute_starts(t, size, stride)
    return {(i, w) for i, x in enumerate(t) for w, s in enumerate(starts) if s <= x < s + size}


@pytest.mark.parametrize(
    "size,stride,t0",
    [(2, 1, 0), (2.5, 1, 0), (0.1, 0.1, 1.5e9), (5, 7, 10), (1000, 1, 0), (3, 0.7, 1.5e9), (1, 0.25, 3)],
)
def test_sliding_windows_match_brute_force(make_packets, size, stride, t0):
    rng = np.random.default_rng(3)
    t = np.sort(t0 + np.round(rng.uniform(0, 20, 150), 3))
    got = win.sliding_windows(make_packets([(x, "a", "b") for x in t]), size, stride)
    pairs = {(r[0], r[1]) for r in got.select("packet_index", "window_id").collect()}
    assert pairs == brute_pairs(t, size, stride)


def test_one_timestamp_and_wide_window_give_one_window(make_packets):
    same = win.sliding_windows(make_packets([(5.0, "a", "b")] * 3), 2, 1)
    assert {r[0] for r in same.select("window_id").collect()} == {0}
    wide = win.sliding_windows(make_packets([(x, "a", "b") for x in range(10)]), 1000, 1)
    assert {r[0] for r in wide.select("window_id").collect()} == {0}


def test_tail_is_dropped_unless_kept(make_packets):
    packets = make_packets([(x, "a", "b") for x in (0, 1, 2, 3, 4.5)])
    assert win.sliding_windows(packets, 2, 1).where("timestamp = 4.5").isEmpty()
    assert not win.sliding_windows(packets, 2, 1, keep_tail=True).where("timestamp = 4.5").isEmpty()


def test_tumbling_windows(make_packets):
    got = win.tumbling_window(make_packets([(10, "a", "b"), (13.9, "a", "b"), (14, "a", "b")]), 4.0).orderBy("timestamp")
    assert [tuple(r) for r in got.select("window_id", "window_start").collect()] == [(0, 10.0), (0, 10.0), (1, 14.0)]


def one_flow(make_packets, rows):
    return fl.sliding_flows(make_packets(rows), 100, 100).collect()


def test_no_packets_no_flows(make_packets):
    assert fl.sliding_flows(make_packets([(1, "a", "b")]).limit(0), 2, 1).count() == 0


def test_single_packet(make_packets):
    (flow,) = one_flow(make_packets, [(1, "a", "b")])
    assert (flow.packet_count, flow.std_iat, flow.mean_iat) == (1, 0.0, 0.0)


def test_two_packets(make_packets):
    (flow,) = one_flow(make_packets, [(1, "a", "b", 100, 0), (2, "a", "b", 200, 1)])
    assert (flow.packet_count, flow.total_bytes, flow.label) == (2, 384, 1)
    assert flow.mean_iat == pytest.approx(0.5) and flow.std_iat == pytest.approx(0.5**0.5)


def test_two_sources_two_flows(make_packets):
    assert len(one_flow(make_packets, [(1, "a", "b"), (1, "c", "b")])) == 2


def brute_flows(p, size, stride):
    starts = brute_starts(p.timestamp.to_numpy(), size, stride)
    out = []
    for w, s in enumerate(starts):
        part = p[(p.timestamp >= s) & (p.timestamp < s + size)]
        for key, g in part.groupby(fl.FLOW_KEY):
            gap = g.timestamp.sort_values().diff().fillna(0)
            std = gap.std() if len(g) > 1 else 0.0
            out.append((w, *key, len(g), g.packet_length.sum(), g.payload_length.mean(), gap.mean(), std, g.label.max()))
    return sorted(out)


@pytest.mark.parametrize("size,stride,splits", [(4, 2, 16), (4, 2, 1), (3, 5, 4), (2.5, 1.1, 7)])
def test_flows_match_brute_force_with_a_hot_flow(make_packets, size, stride, splits):
    rng = np.random.default_rng(11)
    rows = [(round(x, 2), f"h{rng.integers(3)}", f"h{rng.integers(3)}", int(rng.integers(50)), int(rng.integers(2))) for x in rng.uniform(0, 20, 120)]
    # a third of all packets on one flow, many at the same instant
    rows += [(round(x, 1), "h0", "h1", 7, 0) for x in rng.uniform(5, 9, 60)]
    packets = make_packets(rows)
    got = fl.sliding_flows(packets, size, stride, splits=splits).select(
        "window_id", *fl.FLOW_KEY, "packet_count", "total_bytes", "mean_payload", "mean_iat", "std_iat", "label"
    )
    got = sorted(tuple(r) for r in got.collect())
    want = brute_flows(packets.toPandas(), size, stride)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert np.allclose([g[7:] for g in got], [w[7:] for w in want])


def test_snapshot_flows(make_packets):
    packets = make_packets([(t, a, b) for t, a, b in zip(range(8), "ABCABCAB", "BCABCABC")])
    packets = packets.withColumns({"tcp_flags": F.lit(18.0), "udp_length": F.lit(None).cast("double")})
    flows = fl.snapshot_flows(packets, 4.0)
    assert {r.window_start for r in flows.collect()} == {0.0, 4.0}
    assert {r.tcp_flag_syn_rate for r in flows.collect()} == {1.0}
    text = packets.withColumn("tcp_flags", F.lit("PA"))
    assert {r.tcp_flag_syn_rate for r in fl.snapshot_flows(text, 4.0).collect()} == {0.0}


def test_flow_ids_follow_the_order_inside_a_window(make_packets, store):
    rng = np.random.default_rng(2)
    rows = [(float(x), f"10.0.0.{rng.integers(30)}", f"10.0.0.{rng.integers(30)}") for x in rng.uniform(0, 10, 400)]
    flows = fl.with_flow_ids(fl.sliding_flows(make_packets(rows), 2, 1), store).toPandas()
    ordered = flows.sort_values(["window_id", *fl.FLOW_KEY])
    assert (ordered.edge_idx.to_numpy() == ordered.groupby("window_id").cumcount().to_numpy()).all()
    import hashlib

    r = flows.iloc[0]
    raw = f"{r.window_id}:{r.src_ip}:{r.dst_ip}:{r.edge_idx}"
    assert r.flow_id == hashlib.md5(raw.encode()).hexdigest()[:16]


def test_labels_missing_become_normal(spark, make_packets):
    labels = spark.createDataFrame([(0, 1)], "packet_index long, label int")
    merged = fl.merge_labels(make_packets([(1, "a", "b"), (2, "a", "b")]).drop("label"), labels)
    assert sorted((r.packet_index, r.label) for r in merged.collect()) == [(0, 1), (1, 0)]


def test_required_columns_are_checked(make_packets):
    with pytest.raises(ValueError, match="dst_port"):
        fl.prepare_packets(make_packets([(1, "a", "b")]).drop("dst_port"))


def test_packet_gaps(make_packets, store):
    t = [5.0, 1.0, 2.5, 2.5, 9.0]
    got = fl.packet_gaps(make_packets([(x, "a", "b") for x in t]), store).orderBy("timestamp", "packet_index")
    assert [r.inter_arrival_time for r in got.collect()] == [0.0, 1.5, 0.0, 2.5, 4.0]


@pytest.mark.parametrize("n,seq_len,stride,expected", [(3, 5, 1, 0), (5, 5, 1, 1), (0, 5, 1, 0), (9, 5, 2, 3), (6, 2, 10, 1)])
def test_window_sequences(spark, n, seq_len, stride, expected):
    windows = spark.range(n).selectExpr("id * 3 as window_id", "cast(id % 2 as long) as num_malicious")
    rows = win.window_sequences(windows, seq_len, stride).orderBy("sequence_id").collect()
    assert len(rows) == expected
    for r in rows:
        first = r.sequence_id * stride
        assert r.window_ids == [3 * (first + i) for i in range(seq_len)]
        assert r.last_window == r.window_ids[-1] and r.has_attack == ((first + seq_len - 1) % 2 == 1)


def test_splits(spark):
    windows = spark.range(10000).selectExpr("id * 7 as window_id")
    split = win.chronological_split(windows).toPandas().sort_values("window_id").split.tolist()
    assert split == ["train"] * 7000 + ["val"] * 1500 + ["test"] * 1500
    assert {r.split for r in win.chronological_split(windows.limit(2)).collect()} == {"train"}
    few = spark.createDataFrame([(i, i == 3) for i in range(10)], "sequence_id long, has_attack boolean")
    got = {r.sequence_id: r.split for r in win.stratified_split(few).collect()}
    assert got[3] == "train"  # a lone attack sequence cannot be split
    assert [got[i] for i in (0, 1, 2, 4, 5, 6, 7, 8, 9)] == ["train"] * 6 + ["val"] + ["test"] * 2


def flood(make_packets):
    """One flow holds nine packets in ten."""
    return make_packets([(i * 0.01, "a", "b") for i in range(9000)] + [(i * 0.09, f"c{i % 7}", "b") for i in range(1000)])


def test_packets_are_read_and_shuffled_once(make_packets, tmp_path, spark, capsys):
    make_packets([(float(i), "a", "b") for i in range(50)]).write.parquet(str(tmp_path / "p"))
    fl.sliding_flows(spark.read.parquet(str(tmp_path / "p")), 4.0, 2.0).explain("formatted")
    plan = capsys.readouterr().out
    # the shuffles: packets to slices, slices to windows
    assert plan.count(") Scan parquet") == 1 and plan.count(") Exchange") == 2


def test_a_flood_is_spread(make_packets, spark):
    """No task of the first aggregate gets more than its share of the flow with nine packets in ten."""
    packets = flood(make_packets)
    windows = win.SlidingWindows.over(win.time_bounds(packets), 60.0, 30.0)
    spanned = win.sliding_span(fl.prepare_packets(packets), windows).withColumn("_slice", F.floor(F.col("timestamp") / (30.0 / fl.SPLITS)))
    slices = fl._slices(spanned.repartition(16, *fl.FLOW_KEY, "_slice"), [*fl.FLOW_KEY, "first_window", "last_window", "_slice"], {}, {})
    held = [r.n for r in slices.groupBy(F.spark_partition_id()).agg(F.sum("_n").alias("n")).collect()]
    assert len(held) == 16 and max(held) < 2 * sum(held) / 16


@pytest.mark.parametrize("stride", [2.0, 0.5])
def test_joined_slices_make_the_same_flows(make_packets, monkeypatch, stride):
    """With and without the step that joins slices before they go to their windows."""
    packets = flood(make_packets).where("packet_index % 7 = 0")
    key = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    monkeypatch.setattr(fl, "MANY_WINDOWS", 0)
    joined = key(fl.sliding_flows(packets, 4.0, stride))
    monkeypatch.setattr(fl, "MANY_WINDOWS", 100)
    assert key(fl.sliding_flows(packets, 4.0, stride, splits=3)) == joined


def test_sizes_and_ports(make_packets):
    rows = [(0, "a", "b", 10), (1, "a", "b", 90), (2, "a", "b", 20), (9, "c", "b", 1), (10, "c", "b", 2)]
    packets = make_packets(rows).withColumn("src_port", F.when(F.col("packet_index") < 3, F.col("packet_index") % 2))
    wide = {(r.window_id, r.src_ip): (r.min_packet_size, r.max_packet_size, r.unique_src_ports) for r in fl.sliding_flows(packets, 4, 2, wide=True).collect()}
    assert wide[0, "a"] == (52, 132, 2) and wide[1, "a"] == (62, 62, 1) and wide[3, "c"] == (43, 43, 0)
    got = {(r.window_id, r.src_ip): (r.ports, round(r.port_entropy, 9)) for r in fl.port_entropy(packets, 4, 2).collect()}
    assert got == {(0, "a"): (2, round(float(-(2 / 3) * np.log2(2 / 3) - (1 / 3) * np.log2(1 / 3)), 9)), (1, "a"): (1, 0.0)}
