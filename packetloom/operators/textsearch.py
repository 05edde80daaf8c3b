"""Ranked text search with typo tolerance.

Scores are BM25 (k1 = 1.2, b = 0.75). A word of the text matches a query word within an edit distance
that grows with the query word's length; a match at a distance counts less. Words are tested against the few
query words before anything is shuffled, so only matching words leave the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BM25 parameters, word separator, marks around a highlighted word.
K1, B = 1.2, 0.75
SEPARATOR = r"[^\p{L}\p{N}]+"
HIGHLIGHT = ("<em>", "</em>")


def pieces(text: Column | str) -> Column:
    """The text cut at everything that is neither letter nor digit; the ends may be empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.lower(text), SEPARATOR)


def word_count(cut: str) -> Column:
    """Pieces without the empty ones at the ends."""
    first, last = F.element_at(cut, 1) == "", F.element_at(cut, -1) == ""
    alone = F.size(cut) == 1
    return F.size(cut) - first.cast("int") - F.when(alone, 0).otherwise(last.cast("int"))


def allowed_edits(word: str) -> int:
    """0 up to two letters, 1 up to five, 2 beyond."""
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def query_words(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})


def _distance(word: Column, query: str, fuzzy: bool) -> Column:
    """Edits between a word and a query word, -1 if too many. Only words of about the right length are
    compared: ``when`` does not evaluate its branches ahead of time."""
    limit = allowed_edits(query) if fuzzy else 0
    if limit == 0:
        return F.when(word == query, 0).otherwise(-1)
    near = F.abs(F.length(word) - len(query)) <= limit
    return F.when(near, F.levenshtein(word, F.lit(query), limit)).otherwise(-1)


def _matches(word: Column, query: str, fuzzy: bool) -> Column:
    """Array of (query word, boost) that a word matches."""
    tests = []
    for q in query_words(query):
        distance = _distance(word, q, fuzzy)
        boost = 1 - distance / F.least(F.length(word), F.lit(len(q)))
        hit = F.struct(F.lit(q).alias("query_word"), boost.cast("double").alias("boost"))
        tests.append(F.when(distance >= 0, hit))
    return F.array_compact(F.array(*tests))


def _matches_any(word: Column, query: str, fuzzy: bool) -> Column:
    """Cheap test ahead of the structs."""
    out = F.lit(False)
    for q in query_words(query):
        out = F.when(_distance(word, q, fuzzy) >= 0, True).otherwise(out)
    return out


def search_text(
    documents: DataFrame, query: str, key: str, text: str, size: int | None = 10, fuzzy: bool = True
) -> DataFrame:
    """(key, score, matched words) of the best texts. Scores are compared at six decimals, so that the
    order in which parts were added up does not decide; the key breaks ties."""
    split = documents.select(key, pieces(text).alias("_w")).withColumn("_len", word_count("_w"))
    corpus = split.agg(F.struct(F.count("*").alias("n"), F.avg("_len").alias("mean"))).scalar()
    hits = (
        # tested inside the array, so that only matching words become rows
        split.select(
            key, "_len", F.explode(F.filter("_w", lambda w: _matches_any(w, query, fuzzy))).alias("word")
        )
        .withColumn("_m", F.explode(_matches(F.col("word"), query, fuzzy)))
        .groupBy(key, "word", "_m.query_word", "_m.boost")
        .agg(F.count("*").alias("tf"), F.first("_len").alias("_len"))
    )
    # one row per matching word of the vocabulary
    frequency = hits.groupBy("query_word", "word").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("_c.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = K1 * (1 - B + B * F.col("_len") / F.col("_c.mean"))
    part = F.col("boost") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + length)
    ranked = (
        hits.join(frequency, ["query_word", "word"])
        .withColumn("_c", corpus)
        .groupBy(key)
        .agg(F.round(F.sum(part), 6).alias("score"), F.array_sort(F.collect_set("word")).alias("matched"))
        .orderBy(F.col("score").desc(), key)
    )
    return ranked.limit(size) if size else ranked


def with_highlights(results: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """Marks the matched words in the texts of a result list (any number of rows; Spark broadcasts a short one)."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join("matched", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    marked = F.regexp_replace(F.col(text), pattern, F.lit(f"{HIGHLIGHT[0]}$1{HIGHLIGHT[1]}"))
    return documents.select(key, text).join(results, key).withColumn("highlight", marked)
