"""Shared table expressions of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

from packetloom.operators.similarity import projection
from packetloom.schemas import FEATURES

PACKETS = """packets AS (
  SELECT event_id AS packet_index, epoch_us(ts) / 1e6 AS "timestamp",
         '10.0.0.' || (user_id % 6)::VARCHAR AS src_ip,
         '10.0.0.' || (json_extract_string(props, '$.k')::INT % 9)::VARCHAR AS dst_ip,
         (1024 + event_id % 50000)::INT AS src_port,
         CASE WHEN event_type IN ('signup', 'error') THEN 1900 ELSE 80 END AS dst_port,
         CASE WHEN event_type IN ('signup', 'error') THEN 17 ELSE 6 END AS protocol,
         CASE WHEN event_type IN ('signup', 'error') THEN (floor(value)::INT + 8)::DOUBLE END AS udp_length,
         CASE WHEN event_type IN ('signup', 'error') THEN 0.0 ELSE (event_id % 32)::DOUBLE END AS tcp_flags,
         floor(value)::INT AS payload_length, floor(value)::INT + 42 AS packet_length,
         CASE WHEN value > 100 THEN 1 ELSE 0 END AS label
  FROM events)"""

LABELS = """packet_labels AS (SELECT packet_index, label FROM packets WHERE packet_index % 10 <> 0)"""

BOUNDS = """bounds AS (
  SELECT t0, t1, (t0 + 10800.0::DOUBLE) - t0 AS step,
         greatest(1, ceil((t1 - 21600.0::DOUBLE + 1e-9 - t0) / 10800.0::DOUBLE))::BIGINT AS n
  FROM (SELECT min("timestamp") AS t0, max("timestamp") AS t1 FROM packets))"""

PLACED = """placed AS (
  SELECT * FROM (
    SELECT c.*, t0 + window_id * step AS window_start
    FROM (SELECT p.*, b.*, unnest(generate_series(
                   greatest(0, floor(("timestamp" - t0 - 21600) / 10800)::BIGINT - 1),
                   least(n - 1, floor(("timestamp" - t0) / 10800)::BIGINT + 1))) AS window_id
          FROM packets p, bounds b) c)
  WHERE window_start <= "timestamp" AND "timestamp" < window_start + 21600.0::DOUBLE)"""

FLOWS = """gapped AS (
  SELECT *, coalesce("timestamp" - lag("timestamp") OVER (
              PARTITION BY window_id, src_ip, dst_ip, protocol, dst_port ORDER BY "timestamp"), 0) AS iat
  FROM placed),
base_flows AS (
  SELECT window_id, min(window_start) AS window_start, src_ip, dst_ip, protocol, dst_port,
         count(*) AS packet_count, sum(packet_length)::BIGINT AS total_bytes,
         avg(payload_length) AS mean_payload, avg(iat) AS mean_iat,
         coalesce(stddev_samp(iat), 0) AS std_iat, max(label) AS label
  FROM gapped GROUP BY window_id, src_ip, dst_ip, protocol, dst_port),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY src_ip, dst_ip, protocol, dst_port) - 1 AS edge_idx
  FROM base_flows),
scored AS (
  SELECT *, substr(md5(concat_ws(':', window_id, src_ip, dst_ip, edge_idx)), 1, 16) AS flow_id,
         CASE WHEN edge_idx % 7 <> 0 THEN ((window_id * 31 + edge_idx * 17) % 101) / 100.0::DOUBLE END AS prediction_score
  FROM indexed),
flows AS (
  SELECT *, CASE WHEN prediction_score >= 0.5 THEN 1 WHEN prediction_score < 0.5 THEN 0 END AS prediction FROM scored)"""

SEVERE = """severe AS (
  SELECT *, CASE WHEN lvl > 0.9 THEN 'critical' WHEN lvl > 0.7 THEN 'high' WHEN lvl > 0.5 THEN 'medium' ELSE 'low' END AS severity_level,
         coalesce(prediction_score, CASE WHEN label = 1 THEN 0.85::DOUBLE ELSE 0.2::DOUBLE END) AS severity_score,
         CASE WHEN total_bytes > 100000 THEN 'flood' WHEN total_bytes > 10000 THEN 'high'
              WHEN total_bytes > 1000 THEN 'moderate' ELSE 'low' END AS traffic_volume_category
  FROM (SELECT *, coalesce(prediction_score, CASE WHEN label = 1 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END) AS lvl FROM flows))"""

NODES = """nodes AS (
  SELECT window_id, ip, sum(bs)::BIGINT AS bytes_sent, sum(br)::BIGINT AS bytes_recv, sum(ps)::BIGINT AS pkts_sent,
         sum(pr)::BIGINT AS pkts_recv, sum(od)::BIGINT AS out_degree, sum(idg)::BIGINT AS in_degree
  FROM (SELECT window_id, src_ip AS ip, total_bytes AS bs, 0 AS br, packet_count AS ps, 0 AS pr, 1 AS od, 0 AS idg FROM flows
        UNION ALL
        SELECT window_id, dst_ip, 0, total_bytes, 0, packet_count, 0, 1 FROM flows)
  GROUP BY window_id, ip)"""

SUMMARIES = """summaries AS (
  SELECT e.window_id, window_start, num_nodes, num_edges, num_malicious,
         2.0::DOUBLE * num_edges / num_nodes AS mean_degree,
         num_edges / greatest(num_nodes * (num_nodes - 1), 1)::DOUBLE AS density,
         num_malicious / num_edges::DOUBLE AS malicious_ratio
  FROM (SELECT window_id, min(window_start) AS window_start, count(*) AS num_edges,
               sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::BIGINT AS num_malicious FROM flows GROUP BY window_id) e
  JOIN (SELECT window_id, count(*) AS num_nodes FROM nodes GROUP BY window_id) n ON e.window_id = n.window_id)"""



def _embedding_sql() -> str:
    z = ", ".join(
        f"({f} - (SELECT avg({f}) FROM flows)) / (SELECT CASE WHEN stddev_pop({f}) < 1e-8 THEN 1 ELSE stddev_pop({f}) END FROM flows) AS z{i}"
        for i, f in enumerate(FEATURES)
    )
    dims = ", ".join(
        " + ".join(f"z{i} * ({float(w)!r})::DOUBLE" for i, w in enumerate(column)) for column in projection().T
    )
    return f"""embedded AS (
  SELECT flow_id, label, list_transform(raw, lambda x: x / CASE WHEN len = 0 THEN 1 ELSE len END) AS embedding
  FROM (SELECT *, sqrt(list_inner_product(raw, raw)) AS len FROM (
    SELECT flow_id, label, [{dims}] AS raw FROM (SELECT flow_id, label, {z} FROM flows))))"""


EMBEDDED = _embedding_sql()

NEAREST = """nearest_normal AS (
  SELECT flow_id, best.id AS nearest_normal_id, -best.neg AS similarity FROM (
    SELECT a.flow_id, min({'neg': -round(list_cosine_similarity(a.embedding, b.embedding), 6), 'id': b.flow_id}) AS best
    FROM embedded a, embedded b WHERE a.label = 1 AND b.label = 0 GROUP BY a.flow_id)),
diffs AS (
  SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY pct_change DESC, pos) - 1 AS position,
         CASE WHEN cf_value < original_value THEN 'decrease' WHEN cf_value > original_value THEN 'increase' ELSE 'unchanged' END AS direction
  FROM (SELECT flow_id, nearest_normal_id, similarity, pos, feature, original_value, cf_value, abs(original_value - cf_value) AS abs_diff,
               round(least(abs(original_value - cf_value) / CASE WHEN original_value = 0 THEN 1e-9 ELSE abs(original_value) END * 100, 99999.99::DOUBLE), 2) AS pct_change
        FROM (%s))),
lines AS (
  SELECT flow_id, nearest_normal_id, any_value(similarity) AS similarity,
         string_agg('* ' || feature || ' is ' || printf('%%.2f', round(original_value, 2)) || ' here and ' || printf('%%.2f', round(cf_value, 2)) || ' there: ' ||
                    direction || ' by ' || printf('%%.1f', round(pct_change, 1)) || '%%', chr(10) ORDER BY position) AS body
  FROM diffs GROUP BY flow_id, nearest_normal_id),
cfs AS (
  SELECT substr(sha256(flow_id || ':' || nearest_normal_id), 1, 16) AS cf_id, flow_id, nearest_normal_id, similarity AS similarity_score,
         flow_id || ': malicious' || chr(10) || 'compared with ' || nearest_normal_id || ', cosine ' ||
         printf('%%.4f', round(similarity, 4)) || chr(10) || body AS explanation_text
  FROM lines)""" % " UNION ALL ".join(
    f"SELECT n.flow_id, n.nearest_normal_id, n.similarity, {i} AS pos, '{f}' AS feature, a.{f}::DOUBLE AS original_value, b.{f}::DOUBLE AS cf_value "
    "FROM nearest_normal n JOIN flows a ON n.flow_id = a.flow_id JOIN flows b ON n.nearest_normal_id = b.flow_id"
    for i, f in enumerate(FEATURES)
)

STEPS = {
    "packets": [PACKETS],
    "labels": [PACKETS, LABELS],
    "placed": [PACKETS, BOUNDS, PLACED],
    "flows": [PACKETS, BOUNDS, PLACED, FLOWS],
    "severe": [PACKETS, BOUNDS, PLACED, FLOWS, SEVERE],
    "nodes": [PACKETS, BOUNDS, PLACED, FLOWS, NODES],
    "embedded": [PACKETS, BOUNDS, PLACED, FLOWS, EMBEDDED],
    "cfs": [PACKETS, BOUNDS, PLACED, FLOWS, EMBEDDED, NEAREST],
    "summaries": [PACKETS, BOUNDS, PLACED, FLOWS, NODES, SUMMARIES],
}


def sql(base: str, body: str, *more: str) -> str:
    """``WITH <steps of base>, <more> <body>``."""
    return "WITH " + ",\n".join([*STEPS[base], *more]) + "\n" + body
