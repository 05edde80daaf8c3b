"""Registered queries: file scans and sinks, keyed tables, streaming, end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators.scoring import EdgeModel, Scaling, score_edges, window_scores
from packetloom.operators.similarity import feature_embeddings
from packetloom.operators.windows import SlidingWindows, time_bounds
from packetloom.plans import batch
from packetloom.plans.queries_flows import rounded
from packetloom.plans.reference_sql import sql
from packetloom.plans.registry import query
from packetloom.schemas import ALERTS, FEATURES, NODE_FEATURES, PACKETS
from packetloom.sources import files, sinks, testviews
from packetloom.sources.keyed import KeyedTable, ranges
from packetloom.streaming import events as ev
from packetloom.streaming import packets as st


def full_packets(t):
    """All packet columns, in file order."""
    have = set(t.packets.columns)
    return t.packets.select(
        *[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in PACKETS.fields]
    )


def csv_files(t) -> tuple[str, str]:
    def write():
        root = t.store.fresh_path("csv")
        # columns in another order, one too many and some missing; the labels' columns swapped
        shuffled = full_packets(t).drop("label", "ttl").select("dst_ip", F.lit("x").alias("note"), *[
            f.name for f in reversed(PACKETS.fields) if f.name not in ("dst_ip", "label", "ttl")
        ])
        shuffled.write.option("header", True).csv(f"{root}/packets")
        t.labels.select(F.col("label").alias("x"), F.col("packet_index").alias("Unnamed: 0")).write.option("header", True).csv(f"{root}/labels")
        return f"{root}/packets", f"{root}/labels"

    return t.once("csv_files", write)


def json_export(t) -> str:
    def write():
        out = t.store.fresh_path("json")
        files.convert(t.spark, *csv_files(t), out, rows_per_file=1000)
        return out

    return t.once("json_export", write)


_LABELLED = """SELECT p.packet_index, round(p."timestamp", 6) AS "timestamp", p.src_ip, p.dst_port, p.packet_length, coalesce(l.label, 0) AS label
               FROM packets p LEFT JOIN packet_labels l ON p.packet_index = l.packet_index"""
_SCAN_COLUMNS = ["packet_index", "src_ip", "dst_port", "packet_length", "label"]


@query("csv_scan", sql("labels", _LABELLED))
def _(t):
    """Packets and labels written as CSV with columns in any order, read back by name and joined."""
    return files.load_and_merge(t.spark, *csv_files(t)).select(*_SCAN_COLUMNS, *rounded("timestamp"))


@query("json_scan", sql("labels", _LABELLED))
def _(t):
    """Line JSON export, read back through its manifest."""
    out = json_export(t)
    back = files.read_by_manifest(t.spark, f"{out}/packets", f"{out}/manifest")
    return back.select(*_SCAN_COLUMNS, *rounded("timestamp"))


@query("export_manifest", f"SELECT count(*) AS total_rows, {len(PACKETS.fields)} AS columns, true AS small_files FROM events")
def _(t):
    out = json_export(t)
    summary = files.export_summary(files.export_manifest(t.spark, f"{out}/packets"))
    return summary.select(
        "total_rows", F.size("columns").alias("columns"), (F.col("largest") <= 1000).alias("small_files")
    )


@query(
    "packet_upsert",
    sql("packets", "SELECT packet_index, src_ip, CASE WHEN payload_length > 20 THEN 1 - label ELSE label END AS label FROM packets"),
)
def _(t):
    """Packets with larger payloads come again, twice each: first with a wrong label, then with the other one."""
    base = t.packets.select("packet_index", "src_ip", "label")
    larger = t.packets.where("payload_length > 20").select("packet_index", "src_ip", (1 - F.col("label")).alias("label"))
    again = larger.withColumn("label", F.lit(7)).withColumn("version", F.lit(1)).unionByName(larger.withColumn("version", F.lit(2)))
    return sinks.upsert(base, again, ["packet_index"], "version").drop("version")


PART_PACKETS = 500  # packets of a part of the stored table


@query(
    "packet_upsert_stored",
    sql(
        "packets",
        f"""SELECT packet_index, src_ip, CASE WHEN packet_index // {PART_PACKETS} % 3 = 1 AND packet_index % 2 = 0 THEN 1 - label ELSE label END AS label,
               packet_index // {PART_PACKETS} % 3 = 1 AS rewritten FROM packets""",
    ),
)
def _(t):
    """A stored table of all packets; then new labels for some packets, twice each. Only the parts that hold them are written."""

    def run():
        table = KeyedTable(t.spark, t.store.fresh_path("keyed_packets"), ["packet_index"], ranges("packet_index", PART_PACKETS))
        table.create(t.packets.select("packet_index", "src_ip", "label", F.lit(0).alias("version")))
        chosen = t.packets.where((F.floor(F.col("packet_index") / PART_PACKETS) % 3 == 1) & (F.col("packet_index") % 2 == 0))
        again = chosen.select("packet_index", "src_ip", (1 - F.col("label")).alias("label"), F.lit(2).alias("version"))
        table.upsert(again.unionByName(again.withColumns({"label": F.lit(7), "version": F.lit(1)})), "version")
        table.vacuum()
        return table

    generation = F.regexp_extract(F.input_file_name(), "generation=([0-9]+)", 1).cast("int")
    rows = t.once("keyed_packets", run).read()
    return rows.select("packet_index", "src_ip", "label", (generation == 1).alias("rewritten"))


@query(
    "flow_upsert",
    sql("flows", "SELECT flow_id, window_id, packet_count + CASE WHEN label = 1 THEN 100 ELSE 0 END AS packet_count FROM flows"),
)
def _(t):
    base = t.flows.select("flow_id", "window_id", "label", "packet_count")
    changed = base.where("label = 1").withColumn("packet_count", F.col("packet_count") + 100)
    return sinks.upsert(base, changed, ["flow_id"], "packet_count").drop("label")


@query(
    "flow_table_by_window",
    sql("flows", "SELECT window_id // 1024 AS window_bucket, count(*) AS n, sum(total_bytes)::BIGINT AS total_bytes FROM flows GROUP BY 1"),
)
def _(t):
    path = t.once("flow_table", lambda: sinks.write_by_window(t.flows, t.store.fresh_path("flow_table")))
    written = t.spark.read.parquet(path)
    return written.groupBy(F.col("window_bucket").cast("long").alias("window_bucket")).agg(
        F.count("*").alias("n"), F.sum("total_bytes").alias("total_bytes")
    )


@query(
    "retention",
    sql("flows", "SELECT flow_id, window_id FROM flows WHERE window_start >= (SELECT max(window_start) FROM flows) - 20 * 86400.0::DOUBLE"),
)
def _(t):
    return sinks.retained(t.flows, keep_days=20).select("flow_id", "window_id")


@query(
    "retention_on_disk",
    sql(
        "flows",
        """SELECT day, count(*) AS n FROM (SELECT floor(window_start / 86400.0)::BIGINT AS day FROM flows)
           WHERE day >= (SELECT floor(max(window_start) / 86400.0)::BIGINT FROM flows) - 20 GROUP BY 1""",
    ),
)
def _(t):
    """Flows stored by day, the folders of old days deleted, and what is left read again."""

    def run():
        path = sinks.write_by_day(t.flows, t.store.fresh_path("by_day"))
        newest = t.flows.agg(F.floor(F.max("window_start") / sinks.DAY)).first()[0]
        sinks.drop_expired(t.spark, path, newest, keep_days=20)
        return path

    return t.spark.read.parquet(t.once("by_day", run)).groupBy(F.col("day").cast("long").alias("day")).agg(F.count("*").alias("n"))


@query(
    "compaction",
    sql("flows", "SELECT floor(window_start / 86400.0)::BIGINT AS day, count(*) AS n, sum(total_bytes)::BIGINT AS total_bytes FROM flows GROUP BY 1"),
)
def _(t):
    table = t.once("compacted", lambda: sinks.compacted(t.flows, t.store.fresh_path("compacted")))
    return table.groupBy("day").agg(F.count("*").alias("n"), F.sum("total_bytes").alias("total_bytes"))


# --- streaming ------------------------------------------------------------------------------

STREAM_WINDOW = 43200.0


def label_scorer(flows):
    """The label as the score, so that the scores of a run are known."""
    score = F.col("label").cast("double")
    return flows.withColumn("prediction_score", score).withColumn("prediction", F.col("label").cast("int"))


def stream_run(t) -> st.StreamTables:
    def run():
        root = t.store.fresh_path("stream")
        full_packets(t).repartitionByRange(4, "timestamp").write.json(f"{root}/in")
        source = st.packet_stream(t.spark, f"{root}/in", max_files=2)
        out = st.StreamTables(f"{root}/out")
        # files may be taken in any order, so the watermark covers the month they span
        return st.run_available(t.spark, source, out, label_scorer, STREAM_WINDOW, watermark="40 days", alert_score=0.15)

    return t.once("stream", run)


def twin_flows(t):
    """The flows of the whole table as the stream makes them."""
    return st.window_flows(st.with_event_time(full_packets(t)), STREAM_WINDOW)


def stream_table(t, name: str, keys: list[str] | None):
    schemas = {"results": st.RESULTS, "alerts": ALERTS}
    return stream_run(t).read(t.spark, name, schemas[name], keys)


_STREAM = """stream_flows AS (
  SELECT floor("timestamp" / 43200.0)::BIGINT AS window_id, src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS packet_count,
         sum(packet_length)::BIGINT AS total_bytes, arg_min(label, packet_index) AS label, avg(payload_length) AS mean_payload,
         (max("timestamp") - min("timestamp")) / count(*) AS mean_iat, coalesce(stddev_samp(gap), 0) AS std_iat
  FROM (SELECT *, coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY floor("timestamp" / 43200.0), src_ip, dst_ip, src_port, dst_port, protocol
                                                              ORDER BY "timestamp", packet_index), 0) AS gap FROM packets) GROUP BY ALL),
stream_results AS (
  SELECT window_id, count(*) AS num_flows, avg(label) AS anomaly_score FROM stream_flows GROUP BY window_id)"""


@query(
    "stream_flows",
    sql("packets", """SELECT window_id, src_ip, dst_ip, src_port, dst_port, protocol, packet_count, total_bytes, label,
         round(mean_payload, 6) AS mean_payload, round(mean_iat, 6) AS mean_iat, round(std_iat, 4) AS std_iat FROM stream_flows""", _STREAM),
)
def _(t):
    return st.newest_per_window(t.spark, stream_run(t), "flows", twin_flows(t).schema).select(
        "window_id", *st.FIVE_TUPLE, "packet_count", "total_bytes", "label", *rounded("mean_payload", "mean_iat"), *rounded("std_iat", digits=4)
    )


@query("stream_flows_batch_twin", sql("packets", """SELECT window_id, src_ip, dst_ip, src_port, dst_port, protocol, packet_count, total_bytes, label FROM stream_flows""", _STREAM))
def _(t):
    flows = twin_flows(t)
    return flows.select("window_id", *st.FIVE_TUPLE, "packet_count", "total_bytes", "label")


@query(
    "stream_window_results",
    sql("packets", """SELECT r.window_id, num_flows, num_flows AS num_embeddings, num_nodes, round(anomaly_score, 6) AS anomaly_score FROM stream_results r
         JOIN (SELECT window_id, count(DISTINCT ip) AS num_nodes FROM (SELECT window_id, src_ip AS ip FROM stream_flows UNION ALL SELECT window_id, dst_ip FROM stream_flows)
               GROUP BY window_id) n ON r.window_id = n.window_id""", _STREAM),
)
def _(t):
    return stream_table(t, "results", ["window_id"]).select(
        "window_id", "num_flows", "num_nodes", "num_embeddings", *rounded("anomaly_score")
    )


@query("stream_alerts", sql("packets", "SELECT window_id, num_flows, round(anomaly_score, 6) AS anomaly_score FROM stream_results WHERE stream_results.anomaly_score >= 0.15", _STREAM))
def _(t):
    """A window that fell below the limit after its first alert is withdrawn by its newest row."""
    return st.active_alerts(t.spark, stream_run(t)).select("window_id", "num_flows", *rounded("anomaly_score"))


@query(
    "stream_model_scores",
    sql("packets", "SELECT window_id, num_flows, true AS same_scores, true AS same_embeddings FROM stream_results", _STREAM),
)
def _(t):
    """The graph model in the stream, with one and with four files per batch, against the model over the whole table: the
    same score for each window, and the same embedding for each flow, however the batches are cut."""
    flows = t.once("twin_flows", lambda: t.store.save(twin_flows(t), "twin-flows"))  # read many times below
    model, scaling = EdgeModel.seeded(), Scaling.fit(flows)

    def score(df):
        return score_edges(df, model, scaling)

    def embed(df):
        return feature_embeddings(df, fitted=scaling.edges)

    def run():
        root = t.store.fresh_path("model_stream")
        full_packets(t).repartitionByRange(4, "timestamp").write.json(f"{root}/in")
        runs = []
        for files_per_batch in (1, 4):
            source = st.packet_stream(t.spark, f"{root}/in", max_files=files_per_batch)
            out = st.StreamTables(f"{root}/out{files_per_batch}")
            runs.append(st.run_available(t.spark, source, out, score, STREAM_WINDOW, watermark="40 days", embed=embed))
        return runs

    tables = t.once("model_streams", run)
    whole = window_scores(score(flows)).withColumnRenamed("anomaly_score", "expected")
    vectors = embed(flows).select("flow_id", F.col("embedding").alias("expected")).join(flows.select("flow_id", "window_id"), "flow_id")
    kinds = embed(flows).schema
    for k, out in enumerate(tables):
        got = out.read(t.spark, "results", st.RESULTS, ["window_id"]).select("window_id", F.col("anomaly_score").alias("s"))
        close = F.abs(F.col("s") - F.col("expected")) < 1e-9
        whole = whole.join(got, "window_id").withColumn(f"_s{k}", close).drop("s")
        got = out.read(t.spark, "embeddings", kinds).select("flow_id", "batch_id", F.col("embedding").alias("e"))
        apart = F.aggregate(F.zip_with("e", "expected", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, b: a + b)
        placed = vectors.join(st.last_touched(t.spark, out), "window_id", "left").join(got, ["flow_id", "batch_id"], "left")
        vectors = placed.withColumn(f"_e{k}", apart < 1e-9).drop("e", "batch_id")
    per_window = vectors.groupBy("window_id").agg(
        F.bool_and(F.coalesce(F.col("_e0") & F.col("_e1"), F.lit(False))).alias("same_embeddings")
    )
    return whole.join(per_window, "window_id").select(
        "window_id", "num_flows", (F.col("_s0") & F.col("_s1")).alias("same_scores"), "same_embeddings"
    )


@query(
    "stream_late_packets",
    sql(
        "packets",
        """SELECT floor("timestamp" / 43200.0)::BIGINT AS window_id, count(*) AS packets, sum(packet_length)::BIGINT AS total_bytes
           FROM packets, (SELECT min("timestamp") AS first FROM packets)
           WHERE NOT ("timestamp" < first + 10 * 86400 AND packet_index % 5 = 0) GROUP BY 1""",
    ),
)
def _(t):
    """A fifth of the packets of the first ten days arrives after everything else, behind a watermark of one hour: exactly
    those are left out."""

    def run():
        root = t.store.fresh_path("late")
        everything = full_packets(t)
        first = everything.agg(F.min("timestamp")).scalar()
        late = (F.col("timestamp") < first + F.lit(10 * 86400.0)) & (F.col("packet_index") % 5 == 0)
        out = st.StreamTables(f"{root}/out")
        for part in (everything.where(~late), everything.where(late)):
            part.write.mode("append").json(f"{root}/in")
            source = st.packet_stream(t.spark, f"{root}/in", max_files=1000)
            st.run_available(t.spark, source, out, label_scorer, STREAM_WINDOW, watermark="1 hour")
        return out

    flows = st.newest_per_window(t.spark, t.once("late_stream", run), "flows", twin_flows(t).schema)
    return flows.groupBy("window_id").agg(F.sum("packet_count").alias("packets"), F.sum("total_bytes").alias("total_bytes"))


@query(
    "stream_severity_breakdown",
    sql(
        "packets",
        """SELECT 'severity' AS breakdown, CASE WHEN label = 1 THEN 'critical' ELSE 'low' END AS category, count(*) AS n FROM stream_flows GROUP BY 2
           UNION ALL SELECT 'volume', CASE WHEN total_bytes > 100000 THEN 'flood' WHEN total_bytes > 10000 THEN 'high'
              WHEN total_bytes > 1000 THEN 'moderate' ELSE 'low' END, count(*) FROM stream_flows GROUP BY 2""",
        _STREAM,
    ),
)
def _(t):
    """The breakdown after the last batch."""
    return st.cumulative_breakdown(t.spark, stream_run(t))


@query(
    "stream_top_flows",
    sql(
        "packets",
        """SELECT window_id, rank, flow_id FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY flow_id) AS rank FROM (
             SELECT window_id, substr(md5(concat_ws(':', window_id, src_ip, dst_ip, src_port, dst_port, protocol)), 1, 16) AS flow_id
             FROM stream_flows WHERE label = 1)) WHERE rank <= 5""",
        _STREAM,
    ),
)
def _(t):
    return st.newest_per_window(t.spark, stream_run(t), "top_flows", st.TOP_FLOWS).select("window_id", "rank", "flow_id")


@query(
    "stream_kpis",
    sql("packets", """SELECT count(*) AS windows, sum(num_flows)::BIGINT AS total_flows, round(avg(anomaly_score), 6) AS mean_score,
          round(max(anomaly_score), 6) AS max_score FROM stream_results""", _STREAM),
)
def _(t):
    kpis = st.run_kpis(stream_table(t, "results", ["window_id"]))
    return kpis.select("windows", "total_flows", *rounded("mean_score", "max_score"))


#: A packet and a label long after all others, which let the watermark pass whatever still waits.
AFTER_ALL = 100 * 86400.0


def label_events(t):
    """The labels as events of their own: ten minutes late for every unit of packet_index % 7."""
    late = (F.col("packet_index") % 7) * F.lit(600.0)
    times = t.packets.select("packet_index", "timestamp")
    return t.labels.join(times, "packet_index").select("packet_index", F.col("label").cast("int").alias("label"), (F.col("timestamp") + late).alias("label_time"))


@query(
    "stream_label_join",
    sql("labels", """SELECT p.packet_index, p.src_ip, CASE WHEN p.packet_index % 7 <= 4 THEN coalesce(l.label, 0) ELSE 0 END AS label
                     FROM packets p LEFT JOIN packet_labels l ON p.packet_index = l.packet_index"""),
)
def _(t):
    """Two streams joined: labels up to 45 minutes late count, later and missing ones leave the packet at 0."""

    def run():
        root = t.store.fresh_path("label_join")

        def go():
            packets = st.packet_stream(t.spark, f"{root}/packets", max_files=2).select("packet_index", "src_ip", "event_time")
            labels = ev.label_stream(t.spark, f"{root}/labels", max_files=3)
            ev.run_to_end(ev.join_labels(packets, labels, "45 minutes", "40 days"), f"{root}/out", f"{root}/progress")

        full_packets(t).repartitionByRange(4, "timestamp").write.json(f"{root}/packets")
        label_events(t).repartitionByRange(4, "label_time").write.json(f"{root}/labels")
        go()
        end = t.packets.agg(F.max("timestamp")).first()[0] + AFTER_ALL
        full_packets(t).limit(1).withColumns({"timestamp": F.lit(end), "packet_index": F.lit(-1).cast("long")}).write.mode("append").json(f"{root}/packets")
        t.spark.range(1).select(F.lit(-2).cast("long").alias("packet_index"), F.lit(0).alias("label"), F.lit(end).alias("label_time")).write.mode("append").json(f"{root}/labels")
        go()
        return f"{root}/out"

    return t.spark.read.parquet(t.once("label_join", run)).where("packet_index >= 0").select("packet_index", "src_ip", "label")


_BURSTS = """bursts AS (
  SELECT src_ip, count(*) AS packets, sum(packet_length)::BIGINT AS total_bytes, round(min("timestamp"), 6) AS started, round(max("timestamp"), 6) AS ended
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY src_ip ORDER BY "timestamp", packet_index) AS session FROM (
    SELECT *, CASE WHEN "timestamp" - lag("timestamp") OVER (PARTITION BY src_ip ORDER BY "timestamp", packet_index) <= 7200 THEN 0 ELSE 1 END AS fresh FROM packets))
  GROUP BY src_ip, session)"""


@query("source_bursts", sql("packets", "SELECT * FROM bursts", _BURSTS))
def _(t):
    """Sessions of each source: packets at most two hours apart."""
    found = ev.bursts(st.with_event_time(full_packets(t)), "2 hours", watermark=None)
    return found.select("src_ip", "packets", "total_bytes", *rounded("started", "ended"))


@query("stream_bursts", sql("packets", "SELECT * FROM bursts", _BURSTS))
def _(t):
    """The same from a stream of files, closed by a packet long after all others."""

    def run():
        root = t.store.fresh_path("bursts")

        def go():
            source = st.packet_stream(t.spark, f"{root}/in", max_files=2)
            ev.run_to_end(ev.bursts(source, "2 hours", "40 days"), f"{root}/out", f"{root}/progress")

        full_packets(t).repartitionByRange(4, "timestamp").write.json(f"{root}/in")
        go()
        end = t.packets.agg(F.max("timestamp")).first()[0] + AFTER_ALL
        full_packets(t).limit(1).withColumns({"timestamp": F.lit(end), "src_ip": F.lit("end")}).write.mode("append").json(f"{root}/in")
        go()
        return f"{root}/out"

    found = t.spark.read.parquet(t.once("stream_bursts", run)).where("src_ip <> 'end'")
    return found.select("src_ip", "packets", "total_bytes", *rounded("started", "ended"))


@query("stream_sliding_flows", sql("flows", "SELECT window_id, src_ip, dst_ip, protocol, dst_port, packet_count, total_bytes, label FROM flows"))
def _(t):
    """Overlapping windows from a stream of files, by panes; closed by a packet long after all others."""
    low, high = time_bounds(t.packets)
    windows = SlidingWindows.over((low, high), testviews.WINDOW_SIZE, testviews.WINDOW_STRIDE)

    def run():
        root = t.store.fresh_path("sliding_stream")

        def go():
            source = st.packet_stream(t.spark, f"{root}/in", max_files=2)
            rows = ev.sliding_counts(source, testviews.WINDOW_SIZE, testviews.WINDOW_STRIDE, low, "40 days")
            ev.run_to_end(rows, f"{root}/out", f"{root}/progress")

        full_packets(t).repartitionByRange(4, "timestamp").write.json(f"{root}/in")
        go()
        full_packets(t).limit(1).withColumns({"timestamp": F.lit(high + AFTER_ALL), "src_ip": F.lit("end")}).write.mode("append").json(f"{root}/in")
        go()
        return f"{root}/out"

    found = t.spark.read.parquet(t.once("sliding_stream", run))
    return found.where(F.col("window_id").between(0, windows.count - 1) & (F.col("src_ip") != "end"))


@query("stream_progress", sql("packets", "SELECT count(*) AS input_rows, count(*) AS observed_rows, 0 AS without_address, 0 AS late_groups, true AS every_batch FROM packets"))
def _(t):
    """The progress rows of a run, one per micro-batch: every packet is counted once and every batch with results has its row."""

    def run():
        root = t.store.fresh_path("logged_stream")
        full_packets(t).repartitionByRange(4, "timestamp").write.json(f"{root}/in")
        source = ev.observed(st.packet_stream(t.spark, f"{root}/in", max_files=1))
        out = st.StreamTables(f"{root}/out")
        with ev.ProgressLog(t.spark, out.path("run_log")) as log:
            st.run_available(t.spark, source, out, label_scorer, STREAM_WINDOW, watermark="40 days")
        return out, log

    out, log = t.once("logged_stream", run)
    batches = out.read(t.spark, "results", st.RESULTS).select("batch_id").distinct().withColumn("has_results", F.lit(1))
    rows = batches.join(log.read().withColumn("logged", F.lit(1)), "batch_id", "full_outer")
    totals = [F.sum(c).alias(c) for c in ("input_rows", "observed_rows", "without_address", "late_groups")]
    return rows.agg(*totals, F.bool_and(F.col("has_results").isNull() | F.col("logged").isNotNull()).alias("every_batch"))


# --- end to end -----------------------------------------------------------------------------


def ingested(t) -> batch.BatchResult:
    return t.once("ingest", lambda: batch.ingest(t.packets, t.store, testviews.WINDOW_SIZE, testviews.WINDOW_STRIDE))


@query(
    "ingest_report",
    sql(
        "summaries",
        """SELECT 'packets' AS item, count(*) AS n FROM packets UNION ALL SELECT 'flows', count(*) FROM flows
           UNION ALL SELECT 'summaries', count(*) FROM summaries UNION ALL SELECT 'embeddings', count(*) FROM flows
           UNION ALL SELECT 'counterfactuals', count(*) FROM flows WHERE label = 1""",
    ),
)
def _(t):
    """The whole batch job, with every malicious flow explained."""
    return batch.ingest_report(ingested(t))


@query(
    "ingest_summaries",
    sql("summaries", """SELECT window_id, num_nodes, num_edges, num_malicious, round(mean_degree, 6) AS mean_degree, round(density, 6) AS density,
                        round(malicious_ratio, 6) AS malicious_ratio FROM summaries"""),
)
def _(t):
    """The values of the summary table that the batch job stored."""
    stored = ingested(t).summaries
    return stored.select("window_id", "num_nodes", "num_edges", "num_malicious", *rounded("mean_degree", "density", "malicious_ratio"))


@query(
    "ingest_embeddings",
    sql("embedded", "SELECT flow_id, label, " + ", ".join(f"round(embedding[{i + 1}], 6) + 0.0::DOUBLE AS e{i}" for i in range(16)) + " FROM embedded"),
)
def _(t):
    """The values of the embedding table that the batch job stored."""
    stored = ingested(t).embeddings
    parts = [(F.round(F.col("embedding")[i], 6) + F.lit(0.0)).alias(f"e{i}") for i in range(16)]
    return stored.select("flow_id", "label", *parts)


_SIGNIFICANT = """SELECT '{section}' AS section, term AS item, (fg - bg) * (fg / bg) AS value FROM (
    SELECT {field} AS term, sum(label) AS c, sum(label) / (SELECT sum(label) FROM flows)::DOUBLE AS fg, count(*) / (SELECT count(*) FROM flows)::DOUBLE AS bg
    FROM flows GROUP BY 1) WHERE c >= 1 AND fg > bg"""

_PERCENTILES = "\n".join(
    f"UNION ALL SELECT 'percentile', 'packet_count:' || label || ':{p}', quantile_cont(v, {p / 100}) FROM u WHERE feature = 'packet_count' GROUP BY label"
    for p in (5, 25, 50, 75, 95, 99)
)


@query(
    "feature_report",
    sql(
        "flows",
        f"""SELECT section, item, round(value, 6) AS value FROM (
              SELECT 'average' AS section, feature || ':' || label AS item, avg(v) AS value FROM u GROUP BY 2
              UNION ALL SELECT 'deviation', feature || ':' || label, stddev_pop(v) FROM u GROUP BY 2
              {_PERCENTILES}
              UNION ALL {_SIGNIFICANT.format(section="significant_source", field="src_ip")}
              UNION ALL {_SIGNIFICANT.format(section="significant_target", field="dst_ip")})""",
        f"""u AS (UNPIVOT (SELECT label, packet_count::DOUBLE AS packet_count, total_bytes::DOUBLE AS total_bytes, mean_payload, mean_iat, std_iat FROM flows)
              ON {", ".join(FEATURES)} INTO NAME feature VALUE v)""",
    ),
)
def _(t):
    return batch.feature_report(t.flows, t.store).select("section", "item", *rounded("value"))


def temporal_dataset(t):
    return t.once(
        "temporal_dataset",
        lambda: batch.temporal_dataset(t.packets, t.labels, t.store, testviews.WINDOW_SIZE, testviews.WINDOW_STRIDE),
    )


@query(
    "temporal_dataset_sizes",
    sql(
        "nodes",
        """SELECT 'edges' AS item, count(*) AS n FROM flows UNION ALL SELECT 'nodes', count(*) FROM nodes
           UNION ALL SELECT 'links', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM flows UNION ALL SELECT count(*) FROM nodes)
           UNION ALL SELECT 'sequences', count(DISTINCT window_id) - 4 FROM flows""",
    ),
)
def _(t):
    """Labels joined, windows built, features normalised, runs of five windows formed."""
    edges, nodes, links, sequences = temporal_dataset(t)
    out = edges.agg(F.count("*").alias("n")).withColumn("item", F.lit("edges"))
    for name, df, n in (("nodes", nodes, F.count("*")), ("links", links, F.sum("n")), ("sequences", sequences, F.count("*"))):
        out = out.unionByName(df.agg(n.alias("n")).withColumn("item", F.lit(name)))
    return out.select("item", "n")


def _scaled_sql(features: list[str], table: str) -> str:
    """Names and values of scaled features, one row each."""
    names = ", ".join(f"'{f}'" for f in features)
    values = ", ".join(
        f"({f} - avg({f}) OVER ()) / (CASE WHEN stddev_pop({f}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({f}) OVER () END)" for f in features
    )
    return f"SELECT *, [{names}] AS names, [{values}] AS scaled FROM {table}"


@query(
    "temporal_dataset_values",
    sql(
        "nodes",
        """SELECT item, key, feature, round(value, 6) + 0.0::DOUBLE AS value FROM (
             SELECT 'edges' AS item, concat_ws(':', window_id, src_ip, dst_ip, protocol, dst_port) AS key,
                    unnest(names) AS feature, unnest(scaled) AS value FROM edge_values
             UNION ALL SELECT 'edges', concat_ws(':', window_id, src_ip, dst_ip, protocol, dst_port), 'label',
                    max(CASE WHEN packet_index % 10 <> 0 THEN label ELSE 0 END) FROM placed GROUP BY ALL
             UNION ALL SELECT 'nodes', concat_ws(':', window_id, ip), unnest(names), unnest(scaled) FROM node_values
             UNION ALL SELECT 'links', concat_ws(':', l.window_id, l.src_ip, l.dst_ip), 'norm',
                    1 / sqrt(any_value(s.in_degree) + 1) * (1 / sqrt(any_value(d.in_degree) + 1)) FROM loops l
                    JOIN nodes s ON l.window_id = s.window_id AND l.src_ip = s.ip
                    JOIN nodes d ON l.window_id = d.window_id AND l.dst_ip = d.ip GROUP BY l.window_id, l.src_ip, l.dst_ip
             UNION ALL SELECT 'sequences', array_to_string(ids, ':'), 'has_attack', attack FROM (
                    SELECT attack, row_number() OVER (ORDER BY window_id) AS i,
                           list(window_id) OVER (ORDER BY window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ids
                    FROM (SELECT window_id, max(CASE WHEN packet_index % 10 <> 0 THEN label ELSE 0 END) AS attack
                          FROM placed GROUP BY window_id)) WHERE i >= 5)""",
        f"edge_values AS ({_scaled_sql(FEATURES, 'flows')})",
        f"node_values AS ({_scaled_sql(NODE_FEATURES, 'nodes')})",
        "loops AS (SELECT window_id, src_ip, dst_ip FROM flows UNION ALL SELECT window_id, ip, ip FROM nodes)",
    ),
)
def _(t):
    """Every number of the dataset in long form."""
    edges, nodes, links, sequences = temporal_dataset(t)

    def long(df, item, key, features):
        pairs = ", ".join(f"'{f}', cast({f} AS double)" for f in features)
        rows = df.select(F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("key"), *features)
        rows = rows.selectExpr("key", f"stack({len(features)}, {pairs}) AS (feature, value)")
        return rows.select(F.lit(item).alias("item"), "key", "feature", (F.round("value", 6) + F.lit(0.0)).alias("value"))

    runs = sequences.withColumn("windows", F.array_join("window_ids", ":"))
    return (
        long(edges, "edges", ["window_id", "src_ip", "dst_ip", "protocol", "dst_port"], [*FEATURES, "label"])
        .unionByName(long(nodes, "nodes", ["window_id", "ip"], NODE_FEATURES))
        .unionByName(long(links, "links", ["window_id", "src_ip", "dst_ip"], ["norm"]))
        .unionByName(long(runs, "sequences", ["windows"], ["has_attack"]))
    )
