"""A stored text index: the ranked search of ``textsearch`` without reading the texts again.

Four tables, each with a folder per batch of documents, so adding documents writes new folders only:

* ``postings``: one row per (term, segment) with the keys, term frequencies and lengths of the segment's documents, and the
  two numbers that bound what a document of it can score. A segment holds about SEGMENT documents of similar length,
  so no row grows with the corpus, however common its term;
* ``vocabulary``: term and the number of its documents;
* ``deletions``: each term under every form that lacks up to two letters of its first PREFIX ones. Two words within an edit
  distance of d share a form with at most d letters gone from either, so near words are an equality lookup;
* ``stats``: number and total length of the documents.

Postings, vocabulary and deletions are split into BUCKETS folders by a hash of their key, and a query reads the folders and
rows of its own terms. The best ``size`` texts are found in two rounds: the segments of the highest bounds are scored, and
of the rest only those whose bound reaches the score of the last of them.
"""

from __future__ import annotations

import zlib
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.textsearch import B, K1, allowed_edits, pieces, query_words, word_count

SEGMENT = 4096
BUCKETS = 16
PREFIX = 7
SPREAD = 1_000_000  # words of the vocabulary per file of a bucket
SPREAD_DOCUMENTS = 50_000  # documents per file of a bucket of postings
FIRST_SEGMENTS = 16
MOST_EDITS = 2


def _bucket(value: Column) -> Column:
    return (F.crc32(value.cast("binary")) % BUCKETS).cast("int")


def _bucket_of(value: str) -> int:
    return zlib.crc32(value.encode()) % BUCKETS


def _without_one(word: Column) -> Column:
    """Every form of a word that lacks one letter; none for the empty word."""
    forms = F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word)))
    )
    return F.when(F.length(word) > 0, forms).otherwise(F.array().cast("array<string>"))


def deletion_forms(term: Column) -> Column:
    """Array of (form, gone): the head of a term without ``gone`` of its letters, up to MOST_EDITS."""
    level = F.array(F.substring(term, 1, PREFIX))
    out = []
    for gone in range(MOST_EDITS + 1):
        if gone:
            level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        out.append(_marked(level, gone))
    return F.concat(*out)


def _marked(forms: Column, gone: int) -> Column:
    return F.transform(forms, lambda form: F.struct(form.alias("form"), F.lit(gone).alias("gone")))


def query_forms(word: str, edits: int) -> set[str]:
    """The forms of a query word that lack up to ``edits`` letters of its head."""
    forms = level = {word[:PREFIX]}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        forms = forms | level
    return forms


def term_counts(words: Column) -> Column:
    """Array of (term, tf) of an array of words: sorted, then cut where a run of equal words begins."""
    ordered = F.sort_array(words)
    n = F.size(words)

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(w) + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(w, a - 1).alias("term"), (b - a).alias("tf")))

    # the sorted array as an argument of a lambda is made once
    return F.when(n > 0, F.flatten(F.transform(F.array(ordered), runs)))


class TextIndex:
    """The index under ``root``. ``key`` names the documents in results; ``key_type`` is its SQL type."""

    def __init__(self, spark: SparkSession, root: str, key: str, key_type: str = "long"):
        self.spark, self.root, self.key, self.key_type = spark, root, key, key_type
        self._listed: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        """A table with its files listed once, until this object adds a batch."""
        if name not in self._listed:
            self._listed[name] = self._open(name)
        return self._listed[name]

    def _open(self, name: str) -> DataFrame:
        columns = {
            "postings": f"term string, segment long, keys array<{self.key_type}>, tfs array<int>, lens array<int>, max_tf int, min_len int, batch long, bucket int",
            "vocabulary": "term string, df long, batch long, bucket int",
            "deletions": "form string, gone int, term string, batch long, bucket int",
            "stats": "n long, texts long, words long, batch long",
        }[name]
        return self.spark.read.schema(columns).parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int, order: list[str]) -> None:
        """One folder per bucket, its rows in order, so a file's statistics tell which terms it holds."""
        writer = df.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket")
        writer.parquet(f"{self.root}/{name}/batch={batch}")
        self._listed.clear()

    def add(self, documents: DataFrame, text: str, batch: int) -> None:
        """Indexes documents under a batch number; the same number again replaces the batch. Keys of different
        batches must differ. The texts are read twice: for the number of texts of each length class, and for their words."""
        kind = F.coalesce(F.floor(F.log2(F.length(text) + F.lit(1.0)) * 4), F.lit(0)).cast("int")
        sizes = {r.kind: r.n for r in documents.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}  # below 200 classes
        parts = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, -(-n // SEGMENT))]) if sizes else F.lit(None).cast("map<int,int>")
        segment = kind.cast("long") * (1 << 32) + F.pmod(F.xxhash64(self.key), F.element_at(parts, kind))
        docs = documents.select(
            F.col(self.key).cast(self.key_type).alias("key"), pieces(text).alias("_w"), segment.alias("segment")
        ).withColumn("_len", word_count("_w"))
        stats = docs.agg(F.count("*").alias("n"), F.count("_len").alias("texts"), F.coalesce(F.sum("_len"), F.lit(0)).cast("long").alias("words"))
        counted = docs.select("key", "segment", "_len", F.explode(term_counts(F.filter("_w", lambda w: w != ""))).alias("c"))
        # spread by bucket and segment: the rows of one (term, segment) meet, and those of a common term do not
        placed = counted.select("key", "segment", "_len", "c.term", "c.tf", _bucket(F.col("c.term")).alias("bucket"))
        spread = max(1, -(-sum(sizes.values()) // SPREAD_DOCUMENTS))
        placed = placed.withColumn("_spread", F.pmod(F.xxhash64("segment"), F.lit(spread)))
        postings = (
            # a number of its own, twice that of the keys: small partitions put together would leave a few tasks all the work
            placed.repartition(2 * BUCKETS * spread, "bucket", "_spread")
            .groupBy("bucket", "_spread", "term", "segment")
            .agg(
                F.sort_array(F.collect_list(F.struct("key", "tf", F.col("_len").alias("len")))).alias("p"),
                F.max("tf").alias("max_tf"),
                F.min("_len").alias("min_len"),
            )
            .select("bucket", "term", "segment", F.col("p.key").alias("keys"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"), "max_tf", "min_len")
        )
        self._write(postings, "postings", batch, ["term", "segment"])
        written = self._read("postings").where(F.col("batch") == batch)
        words = written.groupBy("bucket", "term").agg(F.sum(F.size("keys")).alias("df"))
        self._write(words, "vocabulary", batch, ["term"])
        words = self._read("vocabulary").where(F.col("batch") == batch)
        forms = words.select("term", F.explode(deletion_forms(F.col("term"))).alias("f")).select("f.form", "f.gone", "term")
        forms = forms.groupBy("form", "term").agg(F.min("gone").alias("gone")).withColumn("bucket", _bucket(F.col("form")))
        spread = max(1, words.count() // SPREAD)
        self._write(forms.repartition("bucket", F.pmod(F.xxhash64("form"), F.lit(spread))), "deletions", batch, ["form"])
        stats.write.mode("overwrite").parquet(f"{self.root}/stats/batch={batch}")

    def near_words(self, query: str, fuzzy: bool = True) -> DataFrame:
        """(query_word, term, boost) of the vocabulary's words near the query's words, looked up by their forms."""
        asked = {w: allowed_edits(w) if fuzzy else 0 for w in query_words(query)}
        forms = {w: sorted(query_forms(w, edits)) if edits else [] for w, edits in asked.items()}
        every = sorted({f for fs in forms.values() for f in fs})
        found = self._read("deletions").where(F.col("bucket").isin(sorted({_bucket_of(f) for f in every})) & F.col("form").isin(every))
        tests = []
        for w, fs in forms.items():
            distance = F.levenshtein("term", F.lit(w), asked[w])
            near = F.col("form").isin(fs) & (F.col("gone") <= asked[w]) & (distance >= 0)
            boost = 1 - distance / F.least(F.length("term"), F.lit(len(w)))
            tests.append(F.when(near, F.struct(F.lit(w).alias("query_word"), "term", boost.cast("double").alias("boost"))))
        near = found.select(F.explode(F.array_compact(F.array(*tests))).alias("m")).select("m.*").distinct()
        exact = [F.struct(F.lit(w).alias("query_word"), F.lit(w).alias("term"), F.lit(1.0).alias("boost")) for w, e in asked.items() if not e]
        return near.union(self.spark.range(1).select(F.explode(F.array(*exact)).alias("m")).select("m.*")) if exact else near

    def matched_terms(self, query: str, fuzzy: bool = True) -> list[tuple[str, str, float, int]]:
        """(query_word, term, boost, df), as many as the vocabulary has words within the edits of the query's words."""
        near = self.near_words(query, fuzzy).collect()
        terms = sorted({r.term for r in near})
        wanted = F.col("bucket").isin(sorted({_bucket_of(w) for w in terms})) & F.col("term").isin(terms)
        frequency = dict(self._read("vocabulary").where(wanted).groupBy("term").agg(F.sum("df")).collect())
        return sorted((r.query_word, r.term, r.boost, frequency[r.term]) for r in near if r.term in frequency)

    def _bounds(self, postings: DataFrame, mean: float) -> DataFrame:
        """The most a document of each segment can score: a bound of each of its terms, added up."""
        return (
            postings.groupBy("batch", "segment")
            .agg(F.sum(F.col("weight") * _impact(F.col("max_tf"), F.col("min_len"), mean)).alias("bound"))
        )

    def search(self, query: str, size: int | None = 10, fuzzy: bool = True) -> DataFrame:
        """(key, score, matched) of the best texts, the same as ``search_text`` gives over all indexed documents."""
        empty = self.spark.createDataFrame([], f"{self.key} {self.key_type}, score double, matched array<string>")
        if not query_words(query):
            return empty
        terms = self.matched_terms(query, fuzzy)
        if not terms:
            return empty
        total = self._read("stats").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("texts")).alias("mean")).first()
        weight: dict[str, float] = {}
        for _, term, boost, df in terms:  # every query word that a term matches adds to it
            weight[term] = weight.get(term, 0.0) + boost * log(1 + (total.n - df + 0.5) / (df + 0.5))
        wanted = F.col("bucket").isin(sorted({_bucket_of(w) for w in weight})) & F.col("term").isin(sorted(weight))
        weights = F.create_map(*[F.lit(v) for item in weight.items() for v in item])
        postings = self._read("postings").where(wanted).withColumn("weight", F.element_at(weights, F.col("term")))

        def scored(rows: DataFrame) -> DataFrame:
            each = rows.select("term", "weight", F.explode(F.arrays_zip("keys", "tfs", "lens")).alias("p"))
            part = F.col("weight") * _impact(F.col("p.tfs"), F.col("p.lens"), total.mean)
            return (
                each.groupBy(F.col("p.keys").alias(self.key))
                .agg(F.round(F.sum(part), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))
                .orderBy(F.col("score").desc(), self.key)
            )

        if size is None:
            return scored(postings)
        bounds = self._bounds(postings, total.mean)
        first = bounds.orderBy(F.col("bound").desc(), "batch", "segment").limit(FIRST_SEGMENTS)
        tops = scored(postings.join(first, ["batch", "segment"], "left_semi")).limit(size).select("score").collect()
        reached = min(r.score for r in tops) - 1e-6 if len(tops) == size else 0.0
        return scored(postings.join(bounds.where(F.col("bound") >= reached), ["batch", "segment"], "left_semi")).limit(size)


def _impact(tf: Column, length: Column, mean: float) -> Column:
    """Grows with the frequency and falls with the length, so the extremes of a segment bound it."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(mean or 1.0))))
