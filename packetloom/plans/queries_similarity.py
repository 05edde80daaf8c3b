"""Registered queries: embeddings, nearest neighbours, counterfactuals, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import narrative as nv
from packetloom.functions.vectors import l2_normalise
from packetloom.operators.neighbours import NeighbourIndex, measured
from packetloom.operators import similarity as si
from packetloom.operators.incidents import incident_context
from packetloom.plans.queries_flows import rounded
from packetloom.plans.queries_search import _INCIDENTS, _LOG, _SCOPE, WORST, worst_flow
from packetloom.plans.reference_sql import SEVERE, sql
from packetloom.plans.registry import query
from packetloom.schemas import FEATURES


@query(
    "feature_embeddings",
    sql("embedded", "SELECT flow_id, label, " + ", ".join(f"round(embedding[{i + 1}], 6) AS e{i}" for i in range(16)) + " FROM embedded"),
)
def _(t):
    dims = [F.round(F.col("embedding")[i], 6).alias(f"e{i}") for i in range(si.EMBEDDING_DIM)]
    return si.feature_embeddings(t.flows).select("flow_id", "label", *dims)


@query(
    "unit_vectors",
    """SELECT vec_id, round(v[1] / greatest(sqrt(list_inner_product(v, v)), 1e-8), 6) AS first, round(v[64] / greatest(sqrt(list_inner_product(v, v)), 1e-8), 6) AS last
       FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
)
def _(t):
    unit = t.raw("embeddings").select("vec_id", l2_normalise("embedding").alias("u"))
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query(
    "embedding_dimension_check",
    "SELECT count(*) AS vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong FROM embeddings",
)
def _(t):
    vectors = t.raw("embeddings")
    wrong = si.wrong_dimension(vectors, 64).agg(F.count("*")).scalar()
    return vectors.agg(F.count("*").alias("vectors")).withColumn("wrong", wrong)


def _knn_sql(where: str, k: int) -> str:
    return f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
      SELECT query, neighbour, similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM (
          SELECT a.vec_id::VARCHAR AS query, b.vec_id::VARCHAR AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
          FROM e a, e b WHERE {where})) WHERE rank <= {k}"""


@query("similar_vectors", _knn_sql("true", 5))
def _(t):
    """Any label, the query itself included."""
    e = t.raw("embeddings")
    return si.nearest(e, e, t.store, 5, key="vec_id")


@query("similar_vectors_without_self", _knn_sql("a.vec_id <> b.vec_id", 3))
def _(t):
    e = t.raw("embeddings")
    return si.nearest(e, e, t.store, 3, key="vec_id", exclude_self=True)


@query("nearest_normal_vectors", _knn_sql("a.label = 1 AND b.label = 0", 5))
def _(t):
    return si.nearest_normal(t.raw("embeddings"), t.store, 5, key="vec_id")


@query("nearest_vectors_by_cells", _knn_sql("a.label <> 0 AND b.label = 0", 4))
def _(t):
    """The way for base sides too large to broadcast."""
    e = t.raw("embeddings")
    return si.nearest(e.where("label <> 0"), e.where("label = 0"), t.store, 4, key="vec_id", broadcast_values=0, cells=8, block_rows=16)


@query("nearest_normal_flows", sql("cfs", "SELECT flow_id, nearest_normal_id, similarity_score FROM cfs"))
def _(t):
    return t.counterfactuals.select("flow_id", "nearest_normal_id", "similarity_score")


@query("counterfactual_ids", sql("cfs", "SELECT cf_id, flow_id FROM cfs"))
def _(t):
    return t.counterfactuals.select("cf_id", "flow_id")


@query(
    "counterfactual_differences",
    sql("cfs", """SELECT flow_id, nearest_normal_id, position, feature, round(original_value, 6) AS original_value, round(cf_value, 6) AS cf_value,
                  round(abs_diff, 6) AS abs_diff, pct_change, direction FROM diffs"""),
)
def _(t):
    return si.difference_rows(t.counterfactuals).select(
        "flow_id", "nearest_normal_id", "position", "feature", "pct_change", "direction",
        *rounded("original_value", "cf_value", "abs_diff"),
    )


@query("counterfactual_narratives", sql("cfs", "SELECT flow_id, explanation_text FROM cfs"))
def _(t):
    return t.counterfactuals.select("flow_id", "explanation_text")


@query(
    "flow_counterfactual_join",
    sql("cfs", """SELECT f.flow_id, f.src_ip, f.packet_count, c.cf_id, n.src_ip AS normal_src, n.packet_count AS normal_packets
          FROM cfs c JOIN flows f ON c.flow_id = f.flow_id JOIN flows n ON c.nearest_normal_id = n.flow_id"""),
)
def _(t):
    normal = t.flows.select(
        F.col("flow_id").alias("nearest_normal_id"), F.col("src_ip").alias("normal_src"), F.col("packet_count").alias("normal_packets")
    )
    own = t.flows.select("flow_id", "src_ip", "packet_count")
    return (
        t.counterfactuals.select("cf_id", "flow_id", "nearest_normal_id")
        .join(own, "flow_id")
        .join(normal, "nearest_normal_id")
        .drop("nearest_normal_id")
    )


@query(
    "flow_embedding_join",
    sql("embedded", "SELECT f.flow_id, f.src_ip, f.label, round(embedding[1], 6) AS first FROM flows f JOIN embedded e ON f.flow_id = e.flow_id"),
)
def _(t):
    first = t.embeddings.select("flow_id", F.round(F.col("embedding")[0], 6).alias("first"))
    return t.flows.select("flow_id", "src_ip", "label").join(first, "flow_id")


@query(
    "first_malicious_counterfactuals",
    sql("cfs", "SELECT m.flow_id, c.cf_id FROM (SELECT flow_id FROM flows WHERE label = 1 ORDER BY window_id, edge_idx LIMIT 20) m JOIN cfs c ON m.flow_id = c.flow_id"),
)
def _(t):
    first = si.first_malicious(t.flows, 20).select("flow_id")
    return first.join(t.counterfactuals.select("flow_id", "cf_id"), "flow_id")


@query(
    "counterfactual_report",
    sql("cfs", """SELECT flow_id, string_agg(printf('%-20s: %12s -> %12s  (%s, %s%%)', feature, printf('%.2f', round(original_value, 2)), printf('%.2f', round(cf_value, 2)),
          direction, printf('%.1f', round(pct_change, 1))), chr(10) ORDER BY position) AS report FROM diffs GROUP BY flow_id"""),
)
def _(t):
    return t.counterfactuals.select("flow_id", F.array_join(nv.report_lines(), "\n").alias("report"))


@query("counterfactual_lookup", sql("cfs", "SELECT cf_id, flow_id, nearest_normal_id FROM cfs, worst WHERE flow_id = wid", WORST))
def _(t):
    return t.counterfactuals.where(F.col("flow_id") == worst_flow(t.flows)).select("cf_id", "flow_id", "nearest_normal_id")


_CARDS = """cards AS (
  SELECT flow_id, feature, position, impact, printf('%.2f', round(original_value, 2)) AS original, printf('%.2f', round(cf_value, 2)) AS modified,
         row_number() OVER (PARTITION BY flow_id ORDER BY impact DESC, position) AS place
  FROM (SELECT *, least(abs_diff / greatest(max(abs_diff) OVER (PARTITION BY flow_id), 1), 1) AS impact FROM diffs))"""


@query(
    "explanation_insights",
    sql("cfs", """SELECT flow_id, string_agg(CASE WHEN impact > 0.7 THEN 'main: ' ELSE 'side: ' END || feature || ' from ' || original || ' to ' || modified || ', weight ' || round(impact * 100)::INT || ' of 100',
            chr(10) ORDER BY place) AS insights FROM cards WHERE place <= 4 GROUP BY flow_id""", _CARDS),
)
def _(t):
    cards = t.counterfactuals.withColumn("changes", nv.changes())
    return cards.select("flow_id", F.array_join(nv.insights(), "\n").alias("insights"))


@query(
    "explanation_recommendations",
    sql("cfs", """SELECT flow_id, string_agg(feature || ' (' || original || ', usual ' || modified || '): ' || CASE
            WHEN contains(feature, 'packet') OR contains(feature, 'count') THEN 'find out who sends this many packets and cap their rate'
            WHEN contains(feature, 'byte') OR contains(feature, 'payload') THEN 'look into the payloads for data leaving or answers blown up'
            WHEN contains(feature, 'iat') THEN 'compare the rhythm with that of scripted senders'
            ELSE 'keep watching this value' END,
            chr(10) ORDER BY place) AS recommendations FROM cards WHERE place <= 5 GROUP BY flow_id""", _CARDS),
)
def _(t):
    cards = t.counterfactuals.withColumn("changes", nv.changes())
    return cards.select("flow_id", F.array_join(nv.recommendations(), "\n").alias("recommendations"))


@query(
    "incident_context",
    sql(
        "cfs",
        f"""SELECT 'details' AS section, item, value FROM (UNPIVOT (SELECT title, severity, status, description FROM incidents, worst WHERE id = wid)
              ON title, severity, status, description INTO NAME item VALUE value)
            UNION ALL SELECT 'feature_stats', feature || ':' || label, count(*)::VARCHAR FROM flows, (SELECT unnest([{", ".join(repr(f) for f in FEATURES)}]) AS feature) GROUP BY feature, label
            UNION ALL SELECT 'severity', 'severity:' || severity_level, count(*)::VARCHAR FROM severe GROUP BY severity_level
            UNION ALL SELECT 'severity', 'volume:' || traffic_volume_category, count(*)::VARCHAR FROM severe GROUP BY traffic_volume_category
            UNION ALL SELECT 'logs', flow_id, message FROM (SELECT flow_id, {_LOG} AS message FROM flows, worst WHERE src_ip = wsrc ORDER BY flow_id LIMIT 20)
            UNION ALL SELECT 'graph', 'nodes', count(*)::VARCHAR FROM rnodes
            UNION ALL SELECT 'graph', 'edges', count(*)::VARCHAR FROM scope
            UNION ALL SELECT 'counterfactual', cf_id, nearest_normal_id FROM cfs, worst WHERE flow_id = wid""",
        SEVERE, _INCIDENTS, WORST, _SCOPE,
    ),
)
def _(t):
    return incident_context(t.flows, worst_flow(t.flows), t.counterfactuals)


# --- approximate neighbours -----------------------------------------------------------------

WANTED_SHARE = 0.9


@query(
    "approximate_neighbours",
    sql(
        "flows",
        f"""SELECT 'flows' AS query_set, count(*) AS queries, true AS enough FROM flows WHERE label = 1
            UNION ALL SELECT 'embeddings', count(*), true FROM embeddings WHERE vec_id % 100 = 0""",
    ),
)
def _(t):
    """The stored projection index asked for the five nearest normal flows of every malicious one and for the ten nearest of
    every hundredth embedding: is the share of exact neighbours found at least 0.9?"""

    def indexed(base, key):
        index = NeighbourIndex(t.spark, t.store.fresh_path("neighbours"), key).fit(base)
        index.add(base, 0)
        return index

    flows, vectors = t.embeddings, t.raw("embeddings")
    normal = flows.where("label = 0")
    by_flow = t.once("flow_neighbours", lambda: indexed(normal, "flow_id"))
    by_vector = t.once("embedding_neighbours", lambda: indexed(vectors, "vec_id"))
    found = measured(by_flow, flows.where("label = 1"), normal, t.store, 5).withColumn("query_set", F.lit("flows"))
    other = measured(by_vector, vectors.where("vec_id % 100 = 0"), vectors, t.store, 10, exclude_self=True)
    found = found.unionByName(other.withColumn("query_set", F.lit("embeddings")))
    return found.select("query_set", "queries", (F.col("share") >= WANTED_SHARE).alias("enough"))
