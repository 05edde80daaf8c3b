"""Registered queries: severity, detection, search, incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.severity import with_severity
from packetloom.operators import anomalies as an
from packetloom.operators import incidents as inc
from packetloom.operators import search as se
from packetloom.operators.scoring import with_predictions
from packetloom.plans.queries_flows import rounded, rounded_sql
from packetloom.plans.reference_sql import sql
from packetloom.plans.registry import query
from packetloom.schemas import FEATURES

BRIEF = ["flow_id", "src_ip", "dst_ip", "packet_count", "total_bytes", "label", "prediction_score"]
BRIEF_SQL = ", ".join(BRIEF)
SPAN = 86400.0


@query(
    "flow_severity",
    sql("severe", "SELECT flow_id, severity_level, severity_score, traffic_volume_category FROM severe"),
)
def _(t):
    return with_severity(t.flows).select("flow_id", "severity_level", "severity_score", "traffic_volume_category")


_BASE = """base AS (SELECT """ + ", ".join(f"avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s" for f in FEATURES) + " FROM flows WHERE label = 0)"
_ZS = ", ".join(f"abs(({f} - {f}_m) / CASE WHEN {f}_s <= 0 THEN 1 ELSE {f}_s END) AS z_{f}" for f in FEATURES)


@query(
    "severity_assessment",
    sql(
        "flows",
        f"""SELECT flow_id, round(z, 4) AS max_z_score, CASE WHEN z >= 5 THEN 'critical' WHEN z >= 3 THEN 'high' WHEN z >= 1.5 THEN 'medium' ELSE 'low' END AS severity,
              {rounded_sql(*[f"z_{f}" for f in FEATURES], digits=4)}
            FROM (SELECT *, greatest({", ".join(f"z_{f}" for f in FEATURES)}) AS z FROM (SELECT flow_id, {_ZS} FROM flows, base))""",
        _BASE,
    ),
)
def _(t):
    zs = [f"z_{f}" for f in FEATURES]
    return an.assess_severity(t.flows).select("flow_id", "severity", *rounded("max_z_score", *zs, digits=4))


@query(
    "flows_with_predictions",
    sql("flows", """SELECT flow_id, label, CASE WHEN packet_count > 1 THEN round(label * 0.5 + 0.25, 2)::DOUBLE END AS prediction_score,
          CASE WHEN packet_count > 1 THEN label END AS prediction FROM flows"""),
)
def _(t):
    """Predictions given for flows of more than one packet."""
    score = (F.col("label") * 0.5 + 0.25).alias("prediction_score")
    given = t.flows.where("packet_count > 1").select("flow_id", score, F.col("label").alias("prediction"))
    return with_predictions(t.flows, given).select("flow_id", "label", "prediction_score", "prediction")


@query("detect_by_label", sql("flows", f"SELECT {BRIEF_SQL} FROM flows WHERE label = 1 ORDER BY flow_id LIMIT 50"))
def _(t):
    return an.detect_anomalies(t.flows, "label").select(*BRIEF)


@query(
    "detect_by_score",
    sql("flows", f"SELECT {BRIEF_SQL} FROM flows WHERE prediction = 1 AND prediction_score >= 0.9 ORDER BY prediction_score DESC, flow_id LIMIT 50"),
)
def _(t):
    return an.detect_anomalies(t.flows, "score", 0.9).select(*BRIEF)


@query(
    "detect_by_stats",
    sql(
        "flows",
        f"""SELECT {BRIEF_SQL} FROM flows WHERE packet_count >= (SELECT coalesce(avg(packet_count) + 2 * stddev_pop(packet_count), 0)
              FROM flows WHERE label = 0) ORDER BY flow_id LIMIT 50""",
    ),
)
def _(t):
    return an.detect_anomalies(t.flows, "stats").select(*BRIEF)


_BUCKETS = """buckets AS (
  SELECT *, count(*) OVER w AS history, avg(high_count) OVER w AS cm, stddev_pop(high_count) OVER w AS cs,
         avg(high_mean) OVER w AS mm, stddev_pop(high_mean) OVER w AS ms
  FROM (SELECT src_ip, floor(window_start / 86400.0)::BIGINT AS bucket, sum(packet_count)::DOUBLE AS high_count, avg(total_bytes) AS high_mean
        FROM flows GROUP BY ALL)
  WINDOW w AS (PARTITION BY src_ip ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
records AS (
  SELECT *, 100 * (1 - exp(-greatest((actual - typical) / CASE WHEN spread < 1e-8 THEN 1 ELSE spread END, 0) / 3.0)) AS record_score FROM (
    SELECT src_ip, bucket, 'high_count' AS detector, high_count AS actual, cm AS typical, cs AS spread FROM buckets WHERE history >= 3
    UNION ALL SELECT src_ip, bucket, 'high_mean', high_mean, mm, ms FROM buckets WHERE history >= 3))"""


@query(
    "anomaly_records",
    sql(
        "flows",
        """SELECT src_ip, bucket, detector, round(actual, 4) AS actual, round(typical, 4) AS typical, round(record_score, 4) AS record_score
           FROM records WHERE records.record_score >= 30""",
        _BUCKETS,
    ),
)
def _(t):
    hits = an.anomaly_records(t.flows, SPAN, min_score=30.0, size=None)
    return hits.select("src_ip", "bucket", "detector", *rounded("actual", "typical", "record_score", digits=4))


@query(
    "influencers",
    sql(
        "flows",
        """SELECT field, value, round(100 * sum(carried) / (SELECT sum(actual - typical) FROM hits), 4) AS influencer_score FROM (
             UNPIVOT (SELECT f.src_ip, f.dst_ip, f.protocol::VARCHAR AS protocol, (actual - typical) * packet_count / actual AS carried
                      FROM flows f JOIN hits h ON f.src_ip = h.src_ip AND floor(f.window_start / 86400.0)::BIGINT = h.bucket)
             ON src_ip, dst_ip, protocol INTO NAME field VALUE value) GROUP BY field, value
           HAVING 100 * sum(carried) / (SELECT sum(actual - typical) FROM hits) >= 10""",
        _BUCKETS,
        "hits AS (SELECT * FROM records WHERE detector = 'high_count' AND record_score >= 30)",
    ),
)
def _(t):
    return an.influencers(t.flows, SPAN, 30.0, 10.0).select("field", "value", *rounded("influencer_score", digits=4))


# --- search ---------------------------------------------------------------------------------


@query("detect_all_by_label", sql("flows", f"SELECT {BRIEF_SQL} FROM flows WHERE label = 1"))
def _(t):
    return an.detect_anomalies(t.flows, "label", size=None).select(*BRIEF)


@query("detect_all_by_score", sql("flows", f"SELECT {BRIEF_SQL} FROM flows WHERE prediction = 1 AND prediction_score >= 0.5"))
def _(t):
    return an.detect_anomalies(t.flows, "score", size=None).select(*BRIEF)


@query(
    "detect_all_by_stats",
    sql(
        "flows",
        f"""SELECT {BRIEF_SQL} FROM flows WHERE packet_count >= (
              SELECT avg(packet_count) + 2 * stddev_pop(packet_count) FROM flows WHERE label = 0)""",
    ),
)
def _(t):
    return an.detect_anomalies(t.flows, "stats", size=None).select(*BRIEF)


@query(
    "search_flows",
    sql("flows", f"""SELECT {BRIEF_SQL} FROM flows WHERE label = 1 AND src_ip = '10.0.0.3' AND packet_count >= 2 ORDER BY flow_id LIMIT 20"""),
)
def _(t):
    clauses = se.flow_clauses(label=1, src_ip="10.0.0.3", min_packet_count=2)
    return se.search_flows(t.flows, clauses).select(*BRIEF)


@query(
    "search_anomalous_flows",
    sql("flows", f"SELECT {BRIEF_SQL} FROM flows WHERE prediction = 1 AND prediction_score >= 0.7 ORDER BY prediction_score DESC, flow_id LIMIT 50"),
)
def _(t):
    return se.search_anomalous_flows(t.flows, 0.7).select(*BRIEF)


@query(
    "search_by_severity",
    sql("severe", f"""SELECT {BRIEF_SQL}, severity_score, traffic_volume_category FROM severe WHERE severity_level = 'high'
                      ORDER BY severity_score DESC, flow_id LIMIT 20"""),
)
def _(t):
    return se.search_by_severity(t.flows, "high").select(*BRIEF, "severity_score", "traffic_volume_category")


@query(
    "search_packets",
    sql("packets", """SELECT packet_index, src_ip, dst_ip, protocol, label FROM packets WHERE dst_ip = '10.0.0.2' AND protocol = 17
                      ORDER BY "timestamp", packet_index LIMIT 20"""),
)
def _(t):
    clauses = se.flow_clauses(dst_ip="10.0.0.2", protocol=17)
    return se.search_packets(t.packets, clauses).select("packet_index", "src_ip", "dst_ip", "protocol", "label")


@query(
    "packets_by_time",
    sql("packets", 'SELECT packet_index, src_ip, dst_ip, label FROM packets ORDER BY "timestamp", packet_index LIMIT 5000'),
)
def _(t):
    return se.search_packets(t.packets, size=5000).select("packet_index", "src_ip", "dst_ip", "label")


@query("flow_page_first", sql("flows", """SELECT flow_id, window_id, (SELECT count(*) FROM flows WHERE label = 1) AS total FROM flows
    WHERE label = 1 ORDER BY window_start DESC, flow_id LIMIT 25"""))
def _(t):
    return se.page(t.flows, 25, clauses=[("label", "==", 1)]).select("flow_id", "window_id", "total")


@query(
    "flow_page_after",
    sql("flows", """SELECT flow_id, window_id, (SELECT count(*) FROM flows) AS total FROM flows, bounds
          WHERE window_start < t0 + 50 * step OR (window_start = t0 + 50 * step AND flow_id > '8') ORDER BY window_start DESC, flow_id LIMIT 25"""),
)
def _(t):
    """Continues after window 50, id '8'; the start of that window comes from the flow table."""
    at = t.flows.where("window_id = 50").agg(F.min("window_start")).scalar()
    return se.page(t.flows, 25, after=(at, "8")).select("flow_id", "window_id", "total")


@query(
    "flow_lookup",
    sql("flows", f"SELECT {BRIEF_SQL} FROM flows WHERE flow_id = substr(md5('100:10.0.0.0:10.0.0.1:' || (SELECT min(edge_idx) FROM flows WHERE window_id = 100 AND src_ip = '10.0.0.0' AND dst_ip = '10.0.0.1')), 1, 16)"),
)
def _(t):
    same = "window_id = 100 and src_ip = '10.0.0.0' and dst_ip = '10.0.0.1'"
    wanted = t.flows.where(same).agg(F.min_by("flow_id", "edge_idx")).scalar()
    return se.lookup(t.flows, "flow_id", wanted).select(*BRIEF)


@query(
    "explain_match",
    sql(
        "flows",
        """SELECT flow_id, label = 1 AND coalesce(prediction_score >= 0.5, false) AND packet_count > 1 AS matched,
                  concat_ws(';', 'label == 1=' || (label = 1), 'prediction_score >= 0.5=' || coalesce(prediction_score >= 0.5, false),
                            'packet_count > 1=' || (packet_count > 1)) AS clauses FROM flows""",
    ),
)
def _(t):
    clauses = [("label", "==", 1), ("prediction_score", ">=", 0.5), ("packet_count", ">", 1)]
    text = F.transform("clauses", lambda c: F.concat(c["clause"], F.lit("="), c["ok"].cast("string")))
    return se.explain_match(t.flows, clauses).select("flow_id", "matched", F.array_join(text, ";").alias("clauses"))


# --- incidents ------------------------------------------------------------------------------

_INCIDENTS = """incidents AS (
  SELECT flow_id AS id, src_ip || ' → ' || dst_ip AS title, severity_level AS severity, 'investigating' AS status,
         round(window_start, 6) AS timestamp, src_ip || ',' || dst_ip AS systems,
         packet_count || ' packets with ' || total_bytes || ' bytes, scored ' || round_even(severity_score * 100, 0)::INT || ' of 100' AS description,
         severity_score AS anomaly_score
  FROM severe WHERE label = 1)"""


@query("incidents", sql("severe", "SELECT * FROM incidents", _INCIDENTS))
def _(t):
    out = inc.incidents(t.flows).withColumn("systems", F.array_join("affected_systems", ",")).drop("affected_systems")
    return out.withColumn("timestamp", F.round("timestamp", 6))


@query(
    "incident_text_filter",
    sql("severe", "SELECT id, title FROM incidents WHERE contains(lower(title), lower('→ 10.0.0.3')) OR contains(lower(id), lower('→ 10.0.0.3'))", _INCIDENTS),
)
def _(t):
    return inc.search_incidents(inc.incidents(t.flows), "→ 10.0.0.3").select("id", "title")


@query(
    "incident_kpis",
    sql("severe", """SELECT count(*) AS incidents, count(*) FILTER (WHERE severity = 'critical') AS critical,
          count(*) FILTER (WHERE status = 'investigating') AS active, round(avg(anomaly_score), 6) AS mean_score FROM incidents""", _INCIDENTS),
)
def _(t):
    return inc.incident_kpis(inc.incidents(t.flows)).select("incidents", "critical", "active", *rounded("mean_score"))


_LOG = """CASE WHEN label = 1 THEN 'malicious: ' ELSE '' END || packet_count || ' packets, ' || total_bytes || ' bytes from ' || src_ip || ' to ' || dst_ip"""


@query(
    "log_lines",
    sql("flows", f"SELECT flow_id, round(window_start, 6) AS timestamp, src_ip AS source, {_LOG} AS message, CASE WHEN label = 1 THEN 'CRITICAL' ELSE 'INFO' END AS level FROM flows"),
)
def _(t):
    return inc.log_lines(t.flows).withColumn("timestamp", F.round("timestamp", 6))


def worst_flow(flows):
    """The incident the queries look at: highest scored malicious flow, first id on ties."""
    order = F.struct(-F.coalesce("prediction_score", F.lit(0.0)), F.col("flow_id"))
    return flows.where("label = 1").agg(F.min_by("flow_id", order)).scalar()


WORST = """worst AS (SELECT flow_id AS wid, src_ip AS wsrc, dst_ip AS wdst FROM flows WHERE label = 1
           ORDER BY coalesce(prediction_score, 0) DESC, flow_id LIMIT 1)"""


@query("incident_lookup", sql("severe", "SELECT id, title, severity, anomaly_score FROM incidents, worst WHERE id = wid", _INCIDENTS, WORST))
def _(t):
    return inc.incident(t.flows, worst_flow(t.flows)).select("id", "title", "severity", "anomaly_score")


@query(
    "incident_logs",
    sql("flows", f"SELECT flow_id, {_LOG} AS message FROM flows, worst WHERE src_ip = wsrc ORDER BY flow_id LIMIT 20", WORST),
)
def _(t):
    return inc.incident_logs(t.flows, worst_flow(t.flows)).select("flow_id", "message")


@query(
    "flows_sharing_an_address",
    sql(
        "flows",
        """SELECT flow_id, src_ip, dst_ip FROM flows WHERE src_ip IN (SELECT ip FROM ips) OR dst_ip IN (SELECT ip FROM ips)""",
        """ips AS (SELECT src_ip AS ip FROM flows WHERE prediction_score = 1.0 AND label = 1
                   UNION SELECT dst_ip FROM flows WHERE prediction_score = 1.0 AND label = 1)""",
    ),
)
def _(t):
    critical = t.flows.where("prediction_score = 1.0 and label = 1")
    return inc.sharing_an_address(t.flows, critical).select("flow_id", "src_ip", "dst_ip")


_SCOPE = """scope AS (SELECT * FROM flows, worst WHERE label = 1 AND (src_ip IN (wsrc, wdst) OR dst_ip IN (wsrc, wdst))),
gnodes AS (
  SELECT ip, max(label) AS label, max(s) AS risk FROM (
    SELECT src_ip AS ip, label, coalesce(prediction_score, CASE WHEN label = 1 THEN 0.8::DOUBLE ELSE 0.15::DOUBLE END) AS s FROM scope
    UNION ALL SELECT dst_ip, label, coalesce(prediction_score, CASE WHEN label = 1 THEN 0.8::DOUBLE ELSE 0.15::DOUBLE END) FROM scope) GROUP BY ip),
rnodes AS (SELECT ip, label, CASE WHEN risk > 0.8 THEN 'compromised' WHEN risk > 0.5 THEN 'suspicious' ELSE 'normal' END AS status, round(risk, 3) AS risk FROM gnodes)"""


@query("incident_graph_nodes", sql("flows", "SELECT * FROM rnodes", WORST, _SCOPE))
def _(t):
    return inc.graph_nodes(inc.incident_flows(t.flows, worst_flow(t.flows)))


@query(
    "incident_graph_edges",
    sql("flows", "SELECT src_ip AS source, dst_ip AS target, least(packet_count / 100.0::DOUBLE, 10.0) AS weight, label = 1 AS anomalous FROM scope", WORST, _SCOPE),
)
def _(t):
    return inc.graph_edges(inc.incident_flows(t.flows, worst_flow(t.flows)))


@query(
    "incident_graph_kpis",
    sql(
        "flows",
        """SELECT count(*) FILTER (WHERE status = 'compromised') AS compromised_nodes, count(*) FILTER (WHERE status = 'suspicious') AS suspicious_nodes,
                  (SELECT count(*) FROM scope) AS anomalous_edges FROM rnodes""",
        WORST, _SCOPE,
    ),
)
def _(t):
    scope = inc.incident_flows(t.flows, worst_flow(t.flows))
    return inc.graph_kpis(inc.graph_nodes(scope), inc.graph_edges(scope))


@query("riskiest_nodes", sql("flows", "SELECT ip, status, risk FROM rnodes ORDER BY risk DESC, ip LIMIT 5", WORST, _SCOPE))
def _(t):
    nodes = inc.graph_nodes(inc.incident_flows(t.flows, worst_flow(t.flows)))
    return inc.riskiest_nodes(nodes).select("ip", "status", "risk")
