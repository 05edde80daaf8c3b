"""The registered queries of this folder, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    arrow_tokens,
    bpe_replay,
    decontaminate,
    exact_dedup,
    langid,
    licenses,
    prefix_trie,
    secrets,
    shallot,
    simhash,
    substring,
    topk,
    word_quality,
)
from packetloom.llm.common import table
from packetloom.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Store(spark))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_units(table(spark, sf_dir, "documents"))


ORACLES["op2_license_scan"] = licenses.twin_sql()


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents"), Store(spark)))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"), Store(spark)).drop("_key")


ORACLES["op4_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    return arrow_tokens.read_back(arrow_tokens.write_sequences(docs, Store(spark), vocabulary))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    filters = langid.fit(docs.where(~held_out), Store(spark))
    return langid.identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), Store(spark))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), Store(spark)).drop("_key")


@query
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items, Store(spark)).drop("_key")


@query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return bpe_replay.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


@query
def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), Store(spark))


_FINITE = "embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) IS NOT FALSE"

ORACLES["op11_top_products"] = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE {_FINITE}
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"), Store(spark))


ORACLES["op12_prefix_trie"] = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id
), steps AS (  -- crc32 of the decimal id: each byte, then eight shifts
  SELECT *, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS todo
  FROM own
), hashed AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), todo),
    lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 6 AS h
  FROM steps
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM hashed a LEFT JOIN own b ON a.base = b.conv_id
), prefixes AS (
  SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
), nodes AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * coalesce(length((any_value(turns)[depth]).text), 0) AS saved,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
  FROM prefixes GROUP BY depth, path
), family AS (
  SELECT p.depth, p.path, min(p.conv_id) AS conv_id, min(p.n_convs) AS n_convs, min(p.ends) AS ends,
         count(*) FILTER (c.depth = p.depth + 1) AS n_children, sum(c.saved) AS saved_tokens
  FROM nodes p JOIN nodes c ON c.path[1:p.depth] = p.path GROUP BY p.depth, p.path
), leaves AS (
  SELECT p.depth, p.path, count(*) AS n_leaves
  FROM family p JOIN family c ON c.n_children = 0 AND c.path[1:p.depth] = p.path GROUP BY p.depth, p.path
)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, l.n_leaves,
       CAST(f.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM family f JOIN leaves l ON f.depth = l.depth AND f.path = l.path
LEFT JOIN nodes u ON u.depth = f.depth - 1 AND u.path = f.path[1:f.depth - 1]
"""


@query
def op13_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.cluster(table(spark, sf_dir, "embeddings"), Store(spark))


def _clusters_sql(rounds: int = 5, k: int = 40) -> str:
    """Assignment and means, written out once per round; vectors and centroids as rows of components."""
    parts = [
        f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c
  FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS (
  SELECT vec_id, v, min(struct_pack(d := d, cluster := cluster)) AS best
  FROM (SELECT vec_id, v, cluster, CAST(round(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)) AS BIGINT) AS d FROM v, c{i})
  GROUP BY vec_id, v
)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (
  SELECT cluster, list(m ORDER BY place) AS c FROM (
    SELECT best.cluster AS cluster, place, floor(sum(x) / count(*)) AS m
    FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY 1, 2
  ) GROUP BY cluster
), c{i + 1} AS (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))"""
            )
    return ",\n".join(parts) + f"""
SELECT vec_id, best.cluster AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.cluster = c{rounds}.cluster
"""


ORACLES["op13_shallot_clusters"] = _clusters_sql()
