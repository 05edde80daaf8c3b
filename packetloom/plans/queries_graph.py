"""Registered queries: window graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import graph as g
from packetloom.operators.spectral import spectral_extremes, spectral_measures
from packetloom.operators.search import top_flows_per_window
from packetloom.operators.stats import bucket_counts, normalisation_stats, normalise
from packetloom.plans.batch import prepare_window
from packetloom.plans.queries_flows import rounded, rounded_sql
from packetloom.plans.reference_sql import NODES, SUMMARIES, sql
from packetloom.plans.registry import query
from packetloom.schemas import FEATURES, NODE_FEATURES
from packetloom.sources.testviews import trade_edges


@query("node_features", sql("nodes", "SELECT * FROM nodes"))
def _(t):
    return g.node_features(t.flows).drop("malicious_out")


@query(
    "normalised_node_features",
    sql(
        "nodes",
        "SELECT window_id, ip, "
        + ", ".join(
            f"round(({f} - (SELECT avg({f}) FROM nodes)) / (SELECT CASE WHEN stddev_pop({f}) < 1e-8 THEN 1 ELSE stddev_pop({f}) END FROM nodes), 6) AS {f}"
            for f in NODE_FEATURES
        )
        + " FROM nodes",
    ),
)
def _(t):
    nodes = g.node_features(t.flows).select("window_id", "ip", *NODE_FEATURES)
    return normalise(nodes, NODE_FEATURES).select("window_id", "ip", *rounded(*NODE_FEATURES))


@query(
    "graph_summaries",
    sql("summaries", f"""SELECT window_id, num_nodes, num_edges, num_malicious, round(window_start, 6) AS window_start,
              {rounded_sql("mean_degree", "density", "malicious_ratio")} FROM summaries"""),
)
def _(t):
    out = g.with_window_start(g.graph_summaries(t.flows), t.flows)
    return out.select(
        "window_id", "num_nodes", "num_edges", "num_malicious",
        *rounded("window_start", "mean_degree", "density", "malicious_ratio"),
    )


@query(
    "dataset_summary",
    sql("summaries", """SELECT count(*) AS num_graphs, sum(num_edges)::BIGINT AS total_edges, round(avg(num_edges), 6) AS avg_edges,
              round(avg(num_nodes), 6) AS avg_nodes FROM summaries"""),
)
def _(t):
    return g.dataset_summary(t.flows).select("num_graphs", "total_edges", *rounded("avg_edges", "avg_nodes"))


@query(
    "class_shares",
    sql("flows", """SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM flows), 6) AS percent
                    FROM flows GROUP BY label"""),
)
def _(t):
    return g.class_shares(t.flows).select("label", "n", *rounded("percent"))


for _kind, _dir in (("anomalous", "DESC"), ("normal", "ASC")):

    @query(
        f"most_{_kind}_window",
        sql("summaries", f"""SELECT window_id, num_edges, num_malicious, round(malicious_ratio, 4) AS malicious_ratio FROM summaries
               ORDER BY summaries.malicious_ratio {_dir}, window_id LIMIT 1"""),
    )
    def _(t, kind=_kind):
        best = g.extreme_window(g.graph_summaries(t.flows), kind)
        return best.select("window_id", "num_edges", "num_malicious", F.round("malicious_ratio", 4).alias("malicious_ratio"))


@query(
    "recent_graph_summaries",
    sql("summaries", "SELECT window_id, num_nodes, num_edges FROM summaries ORDER BY window_id DESC LIMIT 5"),
)
def _(t):
    return g.recent_windows(g.graph_summaries(t.flows), 5).select("window_id", "num_nodes", "num_edges")


@query("graph_summary_lookup", sql("summaries", "SELECT window_id, num_nodes, num_edges, num_malicious FROM summaries WHERE window_id = 17"))
def _(t):
    """The filter reaches the flow scan, so only one window is summarised."""
    one = g.graph_summaries(t.flows).where(F.col("window_id") == 17)
    return one.select("window_id", "num_nodes", "num_edges", "num_malicious")


@query("degrees", sql("nodes", "SELECT window_id, ip, out_degree, in_degree, out_degree + in_degree AS total_degree FROM nodes"))
def _(t):
    return g.degrees(t.flows)


@query("degree_matrix", sql("nodes", "SELECT window_id, ip AS row, ip AS col, out_degree + in_degree AS value FROM nodes"))
def _(t):
    return g.degree_matrix(t.flows, "total")


@query("adjacency", sql("flows", "SELECT window_id, src_ip, dst_ip, count(*) AS weight FROM flows GROUP BY ALL"))
def _(t):
    return g.adjacency(t.flows)


_SYM = """sym AS (SELECT window_id, src_ip AS row, dst_ip AS col FROM flows UNION SELECT window_id, dst_ip, src_ip FROM flows),
deg AS (SELECT window_id, row, count(*) AS d FROM sym GROUP BY ALL)"""


_LAPLACIAN = """SELECT window_id, row, col, sum(value) AS value FROM (
             SELECT window_id, row, col, -1.0::DOUBLE AS value FROM sym UNION ALL SELECT window_id, row, row, d::DOUBLE FROM deg) GROUP BY ALL"""


@query("laplacian", sql("flows", _LAPLACIAN, _SYM))
def _(t):
    return g.laplacian(t.flows)


@query(
    "normalised_laplacian",
    sql("flows", """SELECT window_id, row, col, round(sum(value), 6) + 0.0::DOUBLE AS value FROM (
             SELECT s.window_id, s.row, s.col, -1.0::DOUBLE / sqrt(a.d * b.d) AS value FROM sym s
             JOIN deg a ON s.window_id = a.window_id AND s.row = a.row JOIN deg b ON s.window_id = b.window_id AND s.col = b.row
             UNION ALL SELECT window_id, row, row, 1.0::DOUBLE FROM deg) GROUP BY window_id, row, col""", _SYM),
)
def _(t):
    return g.laplacian(t.flows, normalised=True).select("window_id", "row", "col", *rounded("value"))


_LOOPS = """loops AS (SELECT window_id, src_ip, dst_ip FROM flows UNION ALL SELECT window_id, ip, ip FROM nodes)"""


@query("edges_with_loops", sql("nodes", "SELECT window_id, src_ip, dst_ip, count(*) AS n FROM loops GROUP BY ALL", _LOOPS))
def _(t):
    return g.edges_with_loops(t.flows).groupBy("window_id", "src_ip", "dst_ip").agg(F.count("*").alias("n"))


_NORMALISED = """SELECT l.window_id, l.src_ip, l.dst_ip, count(*) AS n,
             round(1 / sqrt(any_value(s.in_degree) + 1) * (1 / sqrt(any_value(d.in_degree) + 1)), 6) AS norm FROM loops l
             JOIN nodes s ON l.window_id = s.window_id AND l.src_ip = s.ip JOIN nodes d ON l.window_id = d.window_id AND l.dst_ip = d.ip
             GROUP BY l.window_id, l.src_ip, l.dst_ip"""


@query("normalised_edges", sql("nodes", _NORMALISED, _LOOPS))
def _(t):
    return g.normalised_edges(t.flows).select("window_id", "src_ip", "dst_ip", "n", *rounded("norm"))


# edge removal, by really removing the edge and measuring again
_REMOVAL = """targets AS (
  SELECT * FROM (SELECT f.*, sum(label) OVER (PARTITION BY window_id) AS mal, count(*) OVER (PARTITION BY window_id) AS edges,
                        row_number() OVER (PARTITION BY window_id ORDER BY label DESC, total_bytes DESC, edge_idx) AS rk FROM flows f {where})
  WHERE {pick} AND edges >= 2),
stats AS (
  SELECT t.window_id, t.edge_idx, {before}, {after}
  FROM targets t JOIN flows f ON t.window_id = f.window_id GROUP BY t.window_id, t.edge_idx),
ends AS (
  SELECT t.window_id, t.edge_idx, f.edge_idx AS e, f.src_ip AS ip FROM targets t JOIN flows f ON t.window_id = f.window_id
  UNION ALL SELECT t.window_id, t.edge_idx, f.edge_idx, f.dst_ip FROM targets t JOIN flows f ON t.window_id = f.window_id),
spread AS (
  SELECT window_id, edge_idx, stddev_pop(d0) AS s0, stddev_pop(d1) AS s1 FROM (
    SELECT window_id, edge_idx, ip, count(*)::DOUBLE AS d0, sum(CASE WHEN e <> edge_idx THEN 1 ELSE 0 END)::DOUBLE AS d1 FROM ends GROUP BY ALL)
  GROUP BY window_id, edge_idx)"""


def _removal_sql(where: str = "", pick: str = "rk <= 5 AND (label = 1 OR mal = 0)") -> str:
    parts = _REMOVAL.format(
        where=where,
        pick=pick,
        before=", ".join(f"avg(f.{f}) AS {f}_0" for f in FEATURES),
        after=", ".join(f"avg(f.{f}) FILTER (WHERE f.edge_idx <> t.edge_idx) AS {f}_1" for f in FEATURES),
    )
    columns = ", ".join(
        f"round({f}_1 - {f}_0, 4) AS {f}_delta, round(abs({f}_1 - {f}_0) / greatest(abs({f}_0), 1e-9) * 100, 2) AS {f}_pct_change"
        for f in FEATURES
    )
    own = ", ".join(f"round(t.{f}::DOUBLE, 6) AS edge_{f}" for f in FEATURES)
    body = f"""SELECT t.window_id, t.edge_idx, t.src_ip, t.dst_ip, t.label AS removed_label, {own}, {columns},
                      round(abs(s1 - s0) / greatest(s0, 1e-9), 4) AS structural_impact
               FROM targets t JOIN stats s ON t.window_id = s.window_id AND t.edge_idx = s.edge_idx
               JOIN spread p ON t.window_id = p.window_id AND t.edge_idx = p.edge_idx"""
    return sql("summaries", body, parts)


def _own_rounded(removed):
    return removed.withColumns({f"edge_{f}": F.round(f"edge_{f}", 6) for f in FEATURES})


@query("edge_removal", _removal_sql())
def _(t):
    return _own_rounded(g.edge_removal(t.flows))


@query("edge_removal_chosen", _removal_sql(pick="edge_idx % 7 = 3"))
def _(t):
    """Edges that a caller names."""
    return _own_rounded(g.edge_removal(t.flows, chosen=t.flows.where("edge_idx % 7 = 3")))


@query(
    "edge_removal_worst_window",
    _removal_sql("WHERE window_id = (SELECT window_id FROM summaries ORDER BY malicious_ratio DESC, window_id LIMIT 1)"),
)
def _(t):
    worst = g.extreme_window(g.graph_summaries(t.flows)).select("window_id").scalar()
    return _own_rounded(g.edge_removal(t.flows.where(F.col("window_id") == worst)))


_PICK = """pick AS (
  SELECT CASE WHEN a = b THEN lo ELSE a END AS a, CASE WHEN a = b THEN hi ELSE b END AS b FROM (
    SELECT (SELECT window_id FROM summaries ORDER BY malicious_ratio, window_id LIMIT 1) AS a,
           (SELECT window_id FROM summaries ORDER BY malicious_ratio DESC, window_id LIMIT 1) AS b,
           min(window_id) AS lo, max(window_id) AS hi FROM summaries))"""


@query(
    "window_feature_comparison",
    sql(
        "summaries",
        """SELECT feature, round(ma, 4) AS window_a_mean, round(mb, 4) AS window_b_mean, round(mb - ma, 4) AS delta,
                  round(abs(mb - ma) / greatest(abs(ma), 1e-9) * 100, 2) AS pct_change,
                  CASE WHEN mb > ma THEN 'increase' WHEN mb < ma THEN 'decrease' ELSE 'unchanged' END AS direction
           FROM (SELECT feature, avg(v) FILTER (WHERE window_id = (SELECT a FROM pick)) AS ma,
                        avg(v) FILTER (WHERE window_id = (SELECT b FROM pick)) AS mb
                 FROM (UNPIVOT (SELECT window_id, packet_count::DOUBLE AS packet_count, total_bytes::DOUBLE AS total_bytes,
                                       mean_payload, mean_iat, std_iat FROM flows)
                       ON packet_count, total_bytes, mean_payload, mean_iat, std_iat INTO NAME feature VALUE v) GROUP BY feature)""",
        _PICK,
    ),
)
def _(t):
    return g.compare_features(t.flows)


def _structure_sql(pick: str) -> str:
    side = """SELECT s.window_id AS window_{x}, round(s.window_start, 6) AS start_{x}, s.num_nodes AS nodes_{x}, s.num_edges AS edges_{x},
                round(s.mean_degree, 2) AS mean_degree_{x}, s.mean_degree AS d_{x}, s.num_malicious AS m_{x} FROM summaries s, pick WHERE s.window_id = {x}"""
    return sql(
        "summaries",
        f"""SELECT window_a, start_a, nodes_a, edges_a, mean_degree_a, window_b, start_b, nodes_b, edges_b, mean_degree_b,
              nodes_b - nodes_a AS node_diff, edges_b - edges_a AS edge_diff, round(d_b - d_a, 4) AS degree_shift,
              (edges_b - m_b) - (edges_a - m_a) AS normal_delta, m_b - m_a AS malicious_delta
            FROM ({side.format(x="a")}), ({side.format(x="b")})""",
        pick,
    )


@query("window_structure_comparison", _structure_sql(_PICK))
def _(t):
    return g.compare_structure(t.flows).withColumns({c: F.round(c, 6) for c in ("start_a", "start_b")})


@query("window_pair_comparison", _structure_sql("pick AS (SELECT 3 AS a, 40 AS b)"))
def _(t):
    return g.compare_structure(t.flows, 3, 40).withColumns({c: F.round(c, 6) for c in ("start_a", "start_b")})


def _largest_eigenvalue_sql(name: str, matrix: str, squarings: int = 30) -> str:
    """Largest eigenvalue magnitude per window: norm of a power, by repeated squaring with the scale kept as a logarithm."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT window_id, row, col, value, 0.0::DOUBLE AS scale FROM ({matrix}) WHERE value <> 0)"]
    for i in range(squarings):
        steps.append(
            f"""{name}_{i + 1} AS MATERIALIZED (
  SELECT window_id, row, col, value / top AS value, 2 * scale + ln(top) AS scale
  FROM (SELECT *, max(abs(value)) OVER (PARTITION BY window_id) AS top FROM (
    SELECT a.window_id, a.row, b.col, sum(a.value * b.value) AS value, any_value(a.scale) AS scale
    FROM {name}_{i} a JOIN {name}_{i} b ON a.window_id = b.window_id AND a.col = b.row GROUP BY a.window_id, a.row, b.col))
  WHERE value <> 0)"""
        )
    steps.append(f"{name} AS (SELECT window_id, exp(any_value(scale) / {2**squarings}) AS lam FROM {name}_{squarings} GROUP BY window_id)")
    return ", ".join(steps)


_WINDOWS = "ids AS (SELECT DISTINCT window_id FROM flows)"
_RADIUS = _largest_eigenvalue_sql(
    "radius", "SELECT window_id, src_ip AS row, dst_ip AS col, count(*)::DOUBLE AS value FROM flows GROUP BY ALL"
)
# I + S - 2uu' has, beside 0 for the known vector u of eigenvalue 0 of the Laplacian, the values 2 - lambda
_GAP = _largest_eigenvalue_sql(
    "gap",
    """SELECT a.window_id, a.row, b.row AS col,
              (CASE WHEN a.row = b.row THEN 1 ELSE 0 END) + (CASE WHEN s.row IS NULL THEN 0 ELSE 1 / sqrt(a.d * b.d) END)
              - 2 * sqrt(a.d * b.d) / (SELECT sum(d) FROM deg c WHERE c.window_id = a.window_id) AS value
       FROM deg a JOIN deg b ON a.window_id = b.window_id
       LEFT JOIN sym s ON s.window_id = a.window_id AND s.row = a.row AND s.col = b.row""",
)
_SPECTRA = f"""{_SYM}, {_WINDOWS}, {_RADIUS}, {_GAP}, spectra AS (
  SELECT window_id, round(coalesce(2 - gap.lam, 0), 4) + 0.0::DOUBLE AS spectral_gap, round(coalesce(radius.lam, 0), 4) AS spectral_radius
  FROM ids LEFT JOIN radius USING (window_id) LEFT JOIN gap USING (window_id))"""


def _spectra(t):
    out = spectral_measures(t.flows, t.store)
    return out.select("window_id", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("spectral_gap", "spectral_radius")))


@query("spectral_measures", sql("flows", "SELECT window_id, spectral_gap, spectral_radius FROM spectra", _SPECTRA))
def _(t):
    return _spectra(t)


@query(
    "spectral_extremes",
    sql(
        "flows",
        """SELECT * FROM (SELECT 'fragmented' AS kind, * FROM spectra ORDER BY spectral_gap, window_id LIMIT 5)
           UNION ALL SELECT * FROM (SELECT 'amplified' AS kind, * FROM spectra ORDER BY spectral_radius DESC, window_id LIMIT 5)""",
        _SPECTRA,
    ),
)
def _(t):
    return spectral_extremes(_spectra(t)).select("kind", "window_id", "spectral_gap", "spectral_radius")


@query(
    "node_ids",
    sql(
        "flows",
        """SELECT flow_id, s.id AS src_id, d.id AS dst_id FROM flows f JOIN ids s ON f.src_ip = s.ip JOIN ids d ON f.dst_ip = d.ip""",
        "ids AS (SELECT ip, row_number() OVER (ORDER BY ip) - 1 AS id FROM (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows))",
    ),
)
def _(t):
    return g.edges_by_id(t.flows, g.node_ids(t.flows, t.store)).select("flow_id", "src_id", "dst_id")


@query(
    "top_flows_per_window",
    sql(
        "flows",
        """SELECT window_id, rank, flow_id, prediction_score FROM (
             SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY prediction_score DESC, flow_id) AS rank FROM flows
             WHERE prediction = 1 AND prediction_score >= 0.7) WHERE rank <= 5""",
    ),
)
def _(t):
    return top_flows_per_window(t.flows).select("window_id", "rank", "flow_id", "prediction_score")


@query(
    "prepared_window",
    sql(
        "nodes",
        "SELECT window_id, ip, "
        + ", ".join(
            f"round(({f} - (SELECT avg({f}) FROM nodes)) / (SELECT CASE WHEN stddev_pop({f}) < 1e-8 THEN 1 ELSE stddev_pop({f}) END FROM nodes), 6) AS {f}"
            for f in NODE_FEATURES
        )
        + " FROM nodes WHERE window_id = 30",
    ),
)
def _(t):
    """One window, scaled with what was fitted on all of them."""
    all_nodes = g.node_features(t.flows)
    edge_stats, node_stats = normalisation_stats(t.flows, FEATURES), normalisation_stats(all_nodes, NODE_FEATURES)
    _, nodes, _ = prepare_window(t.flows.where("window_id = 30"), edge_stats, node_stats)
    return nodes.select("window_id", "ip", *rounded(*NODE_FEATURES))


# --- a second, larger graph: suppliers and customers by month of shipment ---------------------

_TRADE = """flows AS (
  SELECT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS window_id, (year(l_shipdate) * 12 + month(l_shipdate))::DOUBLE AS window_start,
         's' || l_suppkey AS src_ip, 'c' || o_custkey AS dst_ip, l_orderkey * 10 + l_linenumber AS edge_idx,
         l_quantity::BIGINT AS packet_count, floor(l_extendedprice)::BIGINT AS total_bytes,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _trade_edges(t):
    """Stored once: operators look at the edges from both ends, and each look would be a join of its own."""
    return t.once("trade_edges", lambda: t.store.save(trade_edges(t.spark, t.sf_dir), "trade-edges"))


@query("trade_node_features", f"WITH {_TRADE}, {NODES} SELECT * FROM nodes")
def _(t):
    return g.node_features(_trade_edges(t)).drop("malicious_out")


@query(
    "trade_summaries",
    f"WITH {_TRADE}, {NODES}, {SUMMARIES} SELECT window_id, num_nodes, num_edges, num_malicious, {rounded_sql('mean_degree', 'density', 'malicious_ratio')} FROM summaries",
)
def _(t):
    out = g.graph_summaries(_trade_edges(t))
    return out.select("window_id", "num_nodes", "num_edges", "num_malicious", *rounded("mean_degree", "density", "malicious_ratio"))


@query(
    "trade_bucket_counts",
    f"WITH {_TRADE} SELECT src_ip AS key, count(*) AS doc_count, sum(total_bytes)::BIGINT AS bytes FROM flows GROUP BY 1",
)
def _(t):
    edges = _trade_edges(t)
    return bucket_counts(edges, "src_ip", [F.sum("total_bytes").alias("bytes")])


@query("trade_adjacency", f"WITH {_TRADE} SELECT window_id, src_ip, dst_ip, count(*) AS weight FROM flows GROUP BY ALL")
def _(t):
    return g.adjacency(_trade_edges(t))


@query("trade_laplacian", f"WITH {_TRADE}, {_SYM} {_LAPLACIAN}")
def _(t):
    return g.laplacian(_trade_edges(t))


@query("trade_normalised_edges", f"WITH {_TRADE}, {NODES}, {_LOOPS} {_NORMALISED}")
def _(t):
    return g.normalised_edges(_trade_edges(t)).select("window_id", "src_ip", "dst_ip", "n", *rounded("norm"))
