"""Approximate nearest neighbours: a stored index of random projections with several tables and probes.

A vector falls into one bucket per table: one bit for each of a table's random directions, set where its
projection is above the middle of a sample. A query looks into its own bucket of every table and into those that differ in
the bits it is least sure of. The index holds every vector, in blocks of at most BLOCK rows: a bucket of any size is
so many blocks, and so are the queries that visit it. Queries meet blocks in an equi-join on the bucket, and every block
answers with its best rows only. What is found is compared exactly; what may be missed is a neighbour that shares no
probed bucket. ``fit`` raises the number of probes until AIM of the exact neighbours of TUNED vectors of the sample, looked for
among all vectors, are met rank by rank. ``recall`` measures the share of exact neighbours found; more tables or probes raise it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.operators.similarity import _RESULT, _SCALE, _best, _matrix, _pairs, _top, _unit, nearest
from packetloom.store import Store

BLOCK = 1024
SAMPLE = 4096  # vectors that place the middles
BUCKET_ROWS = 256  # vectors of a bucket aimed at when the number of bits is chosen
TUNED, NEAR, AIM = 256, 10, 0.95  # vectors that choose the number of probes, their neighbours, and the share to reach
MOST_DOUBTFUL = 12  # bits of a table that a probe may flip
_BLOCKS = "tab int, bucket long, names array<string>, vectors array<array<double>>"


class NeighbourIndex:
    """The index under ``root``: ``fit`` once, ``add`` batches, ``search``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "flow_id", tables: int = 8, probes: int = 4, seed: int = 42):
        self.spark, self.root, self.key = spark, root, key
        self.tables, self.probes, self.seed = tables, probes, seed
        self._shape: tuple[np.ndarray, np.ndarray] | None = None
        self._fitted_probes = probes

    # --- buckets ---

    def fit(self, base: DataFrame) -> "NeighbourIndex":
        """Chooses the number of bits from the number of vectors, the middles from SAMPLE of them (by digest), and the number of
        probes, ``self.probes`` at least, from the neighbours of TUNED of those. Stored."""
        unit = _unit(base, self.key)
        n = unit.count()
        bits = max(2, round(log2(max(n, 1) / BUCKET_ROWS))) if n else 2
        sample = unit.orderBy("vkey").limit(SAMPLE).select("vkey", "vec").toPandas()
        width = max((len(v) for v in sample["vec"]), default=1)
        directions = np.random.default_rng(self.seed).standard_normal((self.tables, bits, width))
        flat = directions.reshape(-1, width)
        middles = np.median(_matrix(sample["vec"]) @ flat.T, axis=0) if len(sample) else np.zeros(len(flat))
        probes = self._probes_for(unit, sample, directions, middles.reshape(self.tables, bits)) if len(sample) else self.probes
        row = [(self.tables, bits, width, probes, flat.ravel().tolist(), middles.tolist())]
        shape = self.spark.createDataFrame(row, "tables int, bits int, width int, probes int, directions array<double>, middles array<double>")
        shape.write.mode("overwrite").parquet(f"{self.root}/shape")
        self._shape = None
        return self

    def _probes_for(self, unit: DataFrame, sample: pd.DataFrame, directions: np.ndarray, middles: np.ndarray) -> int:
        """The least number of probes with which AIM of the NEAR exact neighbours of the sample's first TUNED vectors are met."""
        sample = sample.drop_duplicates("vkey").head(TUNED)
        shared = self.spark.sparkContext.broadcast((sample["vkey"].to_numpy(dtype=object), _matrix(sample["vec"])))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, asked = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                sims = asked @ _matrix(batch["vec"]).T
                sims[names[:, None] == batch["vkey"].to_numpy(dtype=object)[None, :]] = -np.inf
                k = min(NEAR, len(batch))
                at = np.argpartition(sims, len(batch) - k, axis=1)[:, len(batch) - k :]
                value = np.take_along_axis(sims, at, axis=1)
                yield pd.DataFrame(
                    {"q": np.repeat(np.arange(len(asked), dtype="int32"), k), "sim": value.ravel(), "vec": batch["vec"].to_numpy()[at.ravel()]}
                )

        distinct = unit.groupBy("vkey").agg(F.first("vec").alias("vec"))
        found = distinct.mapInPandas(near, "q int, sim double, vec array<double>").where(F.col("sim") > float("-inf"))
        best = Window.partitionBy("q").orderBy(F.col("sim").desc())
        pairs = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= NEAR).toPandas()  # TUNED * NEAR rows at most
        if not len(pairs):
            return self.probes
        bits = middles.shape[1]
        weights = 1 << np.arange(bits, dtype=np.int64)
        codes = flips(bits, (1 << bits) - 1) @ weights  # codes of all masks, in the order of probing
        far, other = (
            np.einsum("nw,tbw->ntb", m, directions) - middles for m in (shared.value[1][pairs["q"].to_numpy()], _matrix(pairs["vec"]))
        )
        apart = np.take_along_axis((far > 0) != (other > 0), np.argsort(np.abs(far), axis=2, kind="stable"), axis=2) @ weights
        by_code = np.argsort(codes)
        at = np.minimum(np.searchsorted(codes[by_code], apart), len(codes) - 1)
        place = np.where(codes[by_code][at] == apart, by_code[at], len(codes))  # no probe reaches the others
        # as ``recall`` counts: a neighbour missed moves those after it up, so a rank needs all before it as well
        needed = pairs.assign(n=place.min(axis=1)).sort_values(["q", "_r"]).groupby("q")["n"].cummax()
        enough = np.sort(needed.to_numpy())[ceil(AIM * len(pairs)) - 1]
        return max(self.probes, min(int(enough), len(codes) - 1))

    def shape(self) -> tuple[np.ndarray, np.ndarray]:
        """Directions (tables, bits, width) and middles (tables, bits); a few kilobytes."""
        if self._shape is None:
            r = self.spark.read.parquet(f"{self.root}/shape").first()
            size = (r.tables, r.bits, r.width)
            self._shape = np.array(r.directions).reshape(size), np.array(r.middles).reshape(size[:2])
            self._fitted_probes = r.probes
        return self._shape

    def _placed(self, vectors: DataFrame, name: str, probing: bool) -> DataFrame:
        """One row (tab, bucket, name, vec) per table, and with probing one per table and probe."""
        directions, middles = self.shape()
        tables, bits, width = directions.shape
        weights = 1 << np.arange(bits, dtype=np.int64)
        masks = flips(bits, self._fitted_probes) if probing else np.zeros((1, bits), bool)
        step = max(1, 32_768 // (tables * len(masks)))  # rows out at a time, about

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), step):
                    part = batch.iloc[lo : lo + step]
                    far = np.einsum("nw,tbw->ntb", _matrix(part["vec"]), directions) - middles
                    own = ((far > 0) * weights).sum(axis=2)
                    # bit places in the order of doubt; mask m flips the places it names in that order
                    doubt = weights[np.argsort(np.abs(far), axis=2, kind="stable")]
                    changed = np.einsum("ntb,mb->ntm", doubt, masks.astype(np.int64))
                    bucket = own[:, :, None] ^ changed
                    rows, tab, _ = np.indices(bucket.shape)
                    at = part.iloc[rows.ravel()]
                    yield pd.DataFrame(
                        {"tab": tab.ravel().astype("int32"), "bucket": bucket.ravel(), "name": at[name].to_numpy(), "vec": at["vec"].to_numpy()}
                    )

        return vectors.select(name, "vec").mapInPandas(run, "tab int, bucket long, name string, vec array<double>")

    def _blocks(self, placed: DataFrame) -> DataFrame:
        """Rows of a bucket in blocks of at most BLOCK. A range shuffle on bucket and name splits a hot bucket over tasks."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for (tab, bucket), rows in batch.groupby(["tab", "bucket"], sort=False):
                    for lo in range(0, len(rows), BLOCK):
                        part = rows.iloc[lo : lo + BLOCK]
                        yield pd.DataFrame(
                            {"tab": [np.int32(tab)], "bucket": [bucket], "names": [part["name"].tolist()], "vectors": [part["vec"].tolist()]}
                        )

        laid_out = placed.repartitionByRange("tab", "bucket", "name").sortWithinPartitions("tab", "bucket", "name")
        return laid_out.mapInPandas(run, _BLOCKS)

    def add(self, base: DataFrame, batch: int, depth: int = 11) -> None:
        """Indexes vectors under a batch number; the same number again replaces the batch. Of equal vectors the ``depth`` smallest
        keys are kept, which is all that a search for fewer neighbours can return."""
        copies = Window.partitionBy("vkey").orderBy("id")
        kept = _unit(base, self.key).withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= depth)
        blocks = self._blocks(self._placed(kept, "id", probing=False))
        blocks.write.mode("overwrite").parquet(f"{self.root}/blocks/batch={batch}")

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(query, neighbour, similarity, rank), at most k per query, of the indexed vectors in the probed buckets."""
        depth = k + 1 if exclude_self else k
        asked = _unit(queries, self.key)
        vectors = asked.groupBy("vkey").agg(F.first("vec").alias("vec"))
        visitors = self._blocks(self._placed(vectors, "vkey", probing=True)).withColumnsRenamed({"names": "q_names", "vectors": "q_vectors"})
        held = self.spark.read.schema(f"{_BLOCKS}, batch int").parquet(f"{self.root}/blocks").drop("batch")

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    order = np.argsort(row.names, kind="stable")
                    base = np.stack(row.vectors)[order]
                    at, scaled = _best(np.stack(row.q_vectors), base, depth)
                    yield _pairs(pd.Series(row.q_names), np.array(row.names, dtype=object)[order], at, scaled)

        # blocks are far larger than Spark takes a row of arrays for: by its estimate it would broadcast them
        found = visitors.join(held.hint("merge"), ["tab", "bucket"]).mapInPandas(compare, _RESULT)
        best = _top(found.groupBy("vkey", "neighbour").agg(F.max("scaled").alias("scaled")), depth)
        out = asked.select("id", "vkey").join(best, "vkey")
        if exclude_self:
            out = out.where(F.col("id") != F.col("neighbour"))
        rank = Window.partitionBy("id").orderBy(F.col("scaled").desc(), "neighbour")
        return (
            out.withColumn("rank", F.row_number().over(rank))
            .where(F.col("rank") <= k)
            .select(F.col("id").alias("query"), "neighbour", (F.col("scaled") / F.lit(float(_SCALE))).alias("similarity"), "rank")
        )


def flips(bits: int, probes: int) -> np.ndarray:
    """Which bits to flip, counted from the most doubtful one: nothing first, then sets in the order of their summed places."""
    reach = min(bits, MOST_DOUBTFUL)
    sets = [c for n in range(reach + 1) for c in combinations(range(reach), n)]
    sets.sort(key=lambda c: (sum(i + 1 for i in c), len(c), c))
    masks = np.zeros((min(probes + 1, len(sets)), bits), bool)
    for row, chosen in zip(masks, sets):
        row[list(chosen)] = True
    return masks


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, share): how many of the exact neighbours were found. A neighbour as near as the exact one of its
    rank counts as found; where none is wanted, none is missed."""
    pairs = exact.select("query", "rank", F.col("similarity").alias("_s")).join(
        found.select("query", "rank", "similarity"), ["query", "rank"], "left"
    )
    hit = F.coalesce(F.col("similarity") >= F.col("_s"), F.lit(False))
    return pairs.agg(
        F.count_distinct("query").alias("queries"), F.count("*").alias("wanted"), F.coalesce(F.avg(hit.cast("double")), F.lit(1.0)).alias("share")
    )


def measured(index: NeighbourIndex, queries: DataFrame, base: DataFrame, store: Store, k: int, exclude_self: bool = False) -> DataFrame:
    """Recall of an index for a set of queries, against the exact search. Queries without any neighbour count as asked."""
    exact = nearest(queries, base, store, k, index.key, exclude_self)
    asked = queries.agg(F.count("*").alias("queries"))
    return asked.crossJoin(recall(index.search(queries, k, exclude_self), exact).drop("queries"))
