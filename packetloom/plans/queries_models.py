"""Registered queries: text search, graph scoring, training."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from packetloom.operators import boosting as bo
from packetloom.operators import scoring as sc
from packetloom.operators import textsearch as ts
from packetloom.operators.textindex import TextIndex
from packetloom.plans.queries_flows import rounded
from packetloom.plans.reference_sql import sql
from packetloom.plans.registry import query
from packetloom.schemas import FEATURES, NODE_FEATURES

DOCUMENT_QUERY = "That heron estion, onenes!"
NARRATIVE_QUERY = "packt_count decreese normal"
MODEL = sc.EdgeModel.seeded()


def search_sql(source: str, key: str, text: str, question: str, size: int) -> str:
    tests = "\nUNION ALL ".join(
        f"SELECT '{q}' AS q, word, {len(q)} AS ql, {ts.allowed_edits(q)} AS edits FROM vocabulary" for q in ts.query_words(question)
    )
    return f"""docs AS (SELECT {key} AS k, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {source}),
tokens AS (SELECT k, len(w) AS dl, unnest(w) AS word FROM docs),
vocabulary AS (SELECT word, count(DISTINCT k) AS df FROM tokens GROUP BY word),
near AS (SELECT q, word, 1 - d / least(length(word), ql)::DOUBLE AS boost FROM (
  SELECT *, levenshtein(regexp_replace(word, '[^\\x00-\\x7F]', '~', 'g'), q) AS d FROM ({tests})) WHERE d <= edits),  -- the twin counts bytes: one per letter
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs),
found AS (
  SELECT k, round(sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score,
         array_to_string(list_sort(list_distinct(list(word))), ',') AS matched
  FROM (SELECT k, word, any_value(dl) AS dl, count(*) AS tf FROM tokens GROUP BY k, word) JOIN near USING (word) JOIN vocabulary USING (word), corpus
  GROUP BY k ORDER BY score DESC, k LIMIT {size})"""


@query(
    "document_search",
    "WITH " + search_sql("documents", "doc_id", "text", DOCUMENT_QUERY, 200) + " SELECT k AS doc_id, score, matched FROM found",
)
def _(t):
    docs = t.raw("documents")
    found = ts.search_text(docs, DOCUMENT_QUERY, "doc_id", "text", size=200)
    return found.select("doc_id", "score", F.array_join("matched", ",").alias("matched"))


_INDEXED_SQL = "WITH " + search_sql("documents", "doc_id", "text", DOCUMENT_QUERY, 200) + " SELECT k AS doc_id, score, matched FROM found"


def document_index(t) -> TextIndex:
    """All documents in one batch."""

    def build():
        index = TextIndex(t.spark, t.store.fresh_path("text_index"), "doc_id")
        index.add(t.raw("documents"), "text", 0)
        return index

    return t.once("text_index", build)


def grown_index(t) -> TextIndex:
    """The same documents added in three batches."""

    def build():
        index = TextIndex(t.spark, t.store.fresh_path("grown_text_index"), "doc_id")
        for batch in range(3):
            index.add(t.raw("documents").where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == batch), "text", batch)
        return index

    return t.once("grown_text_index", build)


@query("indexed_search", _INDEXED_SQL)
def _(t):
    """The document search from the stored index: postings of matched terms are read, no text is."""
    found = document_index(t).search(DOCUMENT_QUERY, size=200)
    return found.select("doc_id", "score", F.array_join("matched", ",").alias("matched"))


@query("indexed_search_grown", _INDEXED_SQL)
def _(t):
    """The same after documents have been added in batches."""
    found = grown_index(t).search(DOCUMENT_QUERY, size=200)
    return found.select("doc_id", "score", F.array_join("matched", ",").alias("matched"))


@query(
    "index_vocabulary",
    r"""SELECT word AS term, count(DISTINCT doc_id) AS df FROM (
          SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1""",
)
def _(t):
    """Every word of the corpus with the number of its documents, as the index stores them."""
    return grown_index(t)._read("vocabulary").groupBy("term").agg(F.sum("df").alias("df"))


@query(
    "narrative_search",
    sql("cfs", "SELECT k AS cf_id, score, matched FROM found", search_sql("cfs", "cf_id", "explanation_text", NARRATIVE_QUERY, 10)),
)
def _(t):
    found = ts.search_text(t.counterfactuals, NARRATIVE_QUERY, "cf_id", "explanation_text")
    return found.select("cf_id", "score", F.array_join("matched", ",").alias("matched"))


@query(
    "document_highlights",
    "WITH "
    + search_sql("documents", "doc_id", "text", DOCUMENT_QUERY, 10)
    + r""" SELECT k AS doc_id, score, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'),
             lambda x: CASE WHEN list_contains(string_split(matched, ','), lower(x)) THEN '<em>' || x || '</em>' ELSE x END), '') AS highlight
           FROM found JOIN documents ON k = doc_id""",
)
def _(t):
    docs = t.raw("documents")
    found = ts.search_text(docs, DOCUMENT_QUERY, "doc_id", "text")
    return ts.with_highlights(found, docs, "doc_id", "text").select("doc_id", "score", "highlight")


# --- graph model ----------------------------------------------------------------------------


def _weighted(names: list[str], weights, bias: float | None = None) -> str:
    out = " + ".join(f"{n} * ({float(w)!r})::DOUBLE" for n, w in zip(names, weights))
    return out if bias is None else f"{out} + ({float(bias)!r})::DOUBLE"


def _z(f: str, table: str) -> str:
    return f"({f} - (SELECT avg({f}) FROM {table})) / (SELECT CASE WHEN stddev_pop({f}) < 1e-8 THEN 1 ELSE stddev_pop({f}) END FROM {table}) AS {f}"


def _model_sql() -> str:
    hidden = range(MODEL.hidden)
    choose = ", ".join(
        "CASE position "
        + " ".join(f"WHEN {p + 1} THEN {_weighted(NODE_FEATURES, w[:, j])}" for p, w in enumerate(MODEL.node_weights))
        + f" END AS h{j}"
        for j in hidden
    )
    ends = [f"s.h{j}" for j in hidden] + [f"d.h{j}" for j in hidden] + [f"e.{f}" for f in FEATURES]
    (w0, b0), (w1, b1) = MODEL.layers
    first = ", ".join(f"greatest({_weighted(ends, w0[:, k], b0[k])}, 0) AS l{k}" for k in range(w0.shape[1]))
    last = _weighted([f"l{k}" for k in range(w0.shape[1])], w1[:, 0], b1[0])
    return f"""znodes AS (SELECT window_id, ip, {", ".join(_z(f, "nodes") for f in NODE_FEATURES)} FROM nodes),
zedges AS (SELECT flow_id, window_id, src_ip, dst_ip, {", ".join(_z(f, "flows") for f in FEATURES)} FROM flows),
places AS (SELECT window_id, least(row_number() OVER (ORDER BY window_id), {len(MODEL.node_weights)}) AS position FROM (SELECT DISTINCT window_id FROM flows)),
projected AS (SELECT window_id, ip, {choose} FROM znodes JOIN places USING (window_id)),
loops AS (SELECT window_id, src_ip, dst_ip FROM flows UNION ALL SELECT window_id, ip, ip FROM nodes),
conv AS (
  SELECT l.window_id, l.dst_ip AS ip, {", ".join(f"sum(h{j} / sqrt(s.in_degree + 1) / sqrt(d.in_degree + 1)) AS h{j}" for j in hidden)}
  FROM loops l JOIN nodes s ON l.window_id = s.window_id AND l.src_ip = s.ip JOIN nodes d ON l.window_id = d.window_id AND l.dst_ip = d.ip
  JOIN projected p ON l.window_id = p.window_id AND l.src_ip = p.ip GROUP BY l.window_id, l.dst_ip),
active AS (SELECT window_id, ip, {", ".join(f"greatest(h{j}, 0) AS h{j}" for j in hidden)} FROM conv),
edge_scores AS (
  SELECT flow_id, window_id, 1 / (1 + exp(-({last}))) AS prediction_score FROM (
    SELECT e.flow_id, e.window_id, {first} FROM zedges e
    JOIN active s ON e.window_id = s.window_id AND e.src_ip = s.ip JOIN active d ON e.window_id = d.window_id AND e.dst_ip = d.ip))"""


_MODEL = _model_sql()
_HIDDEN = [f"h{j}" for j in range(MODEL.hidden)]


@query("graph_convolution", sql("nodes", "SELECT window_id, ip, " + ", ".join(f"round({h}, 6) AS {h}" for h in _HIDDEN) + " FROM conv", _MODEL))
def _(t):
    return sc.graph_convolution(t.flows, MODEL).select("window_id", "ip", *rounded(*_HIDDEN))


@query(
    "edge_embeddings",
    sql(
        "nodes",
        "SELECT flow_id, "
        + ", ".join([f"round(s.{h}, 6) AS {h}_src" for h in _HIDDEN] + [f"round(d.{h}, 6) AS {h}_dst" for h in _HIDDEN] + [f"round({f}, 6) AS {f}" for f in FEATURES])
        + """ FROM zedges e JOIN active s ON e.window_id = s.window_id AND e.src_ip = s.ip
              JOIN active d ON e.window_id = d.window_id AND e.dst_ip = d.ip""",
        _MODEL,
    ),
)
def _(t):
    names = [f"{h}_src" for h in _HIDDEN] + [f"{h}_dst" for h in _HIDDEN] + FEATURES
    return sc.edge_embeddings(t.flows, MODEL).select("flow_id", *rounded(*names))


@query("edge_scores", sql("nodes", "SELECT flow_id, round(prediction_score, 6) AS prediction_score FROM edge_scores", _MODEL))
def _(t):
    return sc.scorer("seeded_graph_model")(t.flows).select("flow_id", *rounded("prediction_score"))


@query(
    "window_scores",
    sql("nodes", "SELECT window_id, round(avg(prediction_score), 6) AS anomaly_score, count(*) AS num_flows FROM edge_scores GROUP BY window_id", _MODEL),
)
def _(t):
    scored = sc.scorer("seeded_graph_model")(t.flows)
    return sc.window_scores(scored).select("window_id", "num_flows", *rounded("anomaly_score"))


@query("edge_classifier_metrics")
def _(t):
    _, metrics = sc.train_edge_classifier(t.flows, t.store)
    return metrics


@query("edge_classifier_stored", sql("flows", "SELECT window_id, count(*) AS n, true AS same, true AS in_range FROM flows GROUP BY window_id"))
def _(t):
    """A trained classifier, stored, loaded, registered as a scorer, and applied to all flows like the one in memory."""

    def train():
        model, _ = sc.train_edge_classifier(t.flows, t.store)
        path = t.store.fresh_path("classifier")
        model.save(path)
        return model, PipelineModel.load(path)

    scaling = sc.Scaling.fit(t.flows)
    scores = []
    for model, name in zip(t.once("classifiers", train), ("trained_classifier", "stored_classifier")):
        sc.register_scorer(name, sc.classifier_scorer(model, scaling))
        scores.append(sc.scorer(name)(t.flows))
    other = scores[1].select("flow_id", F.col("prediction_score").alias("other"))
    score = F.col("prediction_score")
    return scores[0].join(other, "flow_id").groupBy("window_id").agg(
        F.count("*").alias("n"),
        F.bool_and(F.abs(score - F.col("other")) < 1e-12).alias("same"),
        F.bool_and(score.between(0, 1)).alias("in_range"),
    )


@query("boosted_classifier", sql("flows", "SELECT label, count(*) AS n, true AS same, true AS in_range, true AS stopped_early FROM flows GROUP BY label"))
def _(t):
    """Boosted trees with early stopping: the SQL they are exported as scores every flow like the model does."""
    model, _ = t.once("boosted", lambda: bo.train_boosted(t.flows, t.store, trees=40))
    scaling = sc.Scaling.fit(t.flows)
    exported = bo.boosted_scorer(model, scaling)(t.flows).select("flow_id", "prediction_score")
    assembled = PipelineModel([VectorAssembler(inputCols=sc.CLASSIFIER_INPUTS, outputCol="features"), model])
    own = sc.classifier_scorer(assembled, scaling)(t.flows).select("flow_id", F.col("prediction_score").alias("other"))
    score = F.col("prediction_score")
    return t.flows.select("flow_id", "label").join(exported, "flow_id").join(own, "flow_id").groupBy("label").agg(
        F.count("*").alias("n"),
        F.bool_and(F.abs(score - F.col("other")) < 1e-9).alias("same"),
        F.bool_and(score.between(0, 1)).alias("in_range"),
        F.lit(model.getNumTrees < 40).alias("stopped_early"),
    )
