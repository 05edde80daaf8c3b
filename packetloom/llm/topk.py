"""Exact top-k inner products by a three-phase uniform threshold.

Every vector is cut into two lists of components, the even and the odd ones, and each list is stored apart
in blocks of rows. A score is the sum of one entry of each list.

1. Every block gives each query its largest local entries. The other list completes them, and the k-th best
   complete score of a query is a score that k candidates reach: a safe cutoff.
2. The cutoff goes back to all blocks. A candidate whose score reaches it must have an entry of at least
   half of it in some list, so every block hands over exactly these entries. Candidates found in both lists
   are complete and raise the cutoff; the missing entry of the others is below half of the first one.
3. Only candidates whose score can still reach the raised cutoff are completed, by the list they lack.

Queries go to the blocks in blocks, by an equi-join on the block; no task sees more than one block of each.
Of equal vectors only the k + 1 smallest ids can be among anybody's k best, so the others are left out before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.vectors import exact_product, is_finite, matrix, numbered, pack, scaled, unpack
from packetloom.store import Store

LISTS = 2
ROWS = 8192  # candidates of a block
QUERIES = 256  # queries of a block
NO_CUT = -(1 << 62)

_BLOCKS = "block long, list long, ids binary, parts binary, width long"
_FOUND = "block long, part long, list long, at binary, pos binary, entry binary"


def _blocks(rows: DataFrame, id_column: str, size: int) -> DataFrame:
    """(block, list, ids, parts, width) for each list of components of at most `size` rows."""

    def run(batches):
        for number, piece in numbered(batches, size):
            vectors, ids = matrix(piece.column("v")), pack(piece.column(id_column).to_numpy())
            for j in range(LISTS):
                part = vectors[:, j::LISTS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (number, j, ids, pack(part), part.shape[1])], ["block", "list", "ids", "parts", "width"]
                )

    return rows.select(id_column, "v").mapInArrow(run, _BLOCKS)


def _vectors(data: bytes, width: int) -> np.ndarray:
    values = unpack(data)
    return values.reshape(-1, width) if width else values.reshape(0, 0)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _over_pairs(queries: DataFrame, parts: DataFrame, tasks: int, fn: Callable[[dict, np.ndarray], dict], schema: str) -> DataFrame:
    """`fn` on every pair of a query block and a candidate block of the same list, with the matrix of local entries."""
    names = [name for name in parts.columns if name != "list"]
    right = parts.select("list", *[F.col(n).alias(f"c_{n}") for n in names]).repartition(tasks, "list", "c_block")
    blocks = parts.select("list", F.col("block").alias("c_block"))
    left = queries.join(blocks, "list").repartition(tasks, "list", "c_block").hint("merge")

    def run(batches):
        for row in _each(batches):
            width = min(row["width"], row["c_width"])
            a, b = _vectors(row["parts"], row["width"]), _vectors(row["c_parts"], row["c_width"])
            if not width:
                a, b = np.zeros((len(unpack(row["ids"])), 1), np.int64), np.zeros((len(unpack(row["c_ids"])), 1), np.int64)
            for out in fn(row, exact_product(a, b)):
                yield out

    return left.join(right, ["list", "c_block"]).mapInArrow(run, schema)


def _found(row: dict, at: np.ndarray, pos: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
    values = (row["block"], row["c_block"], row["list"], pack(at), pack(pos), pack(entry))
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["block", "part", "list", "at", "pos", "entry"])


def _largest(most: int):
    """The `most` largest entries of each query of a block."""

    def fn(row, entries):
        n = min(most, entries.shape[1])
        pos = np.argpartition(-entries, n - 1, axis=1)[:, :n] if n else np.zeros((len(entries), 0), np.int64)
        at = np.repeat(np.arange(len(entries)), n)
        yield _found(row, at, pos.ravel(), entries[at, pos.ravel()])

    return fn


def _reaching(row, entries):
    """All entries that are at least half of their query's cutoff."""
    cuts = unpack(row["cuts"])
    at, pos = np.nonzero(entries * LISTS >= cuts[:, None])
    yield _found(row, at, pos, entries[at, pos])


def _completed(found: DataFrame, queries: DataFrame, parts: DataFrame) -> DataFrame:
    """(q, vec_id, score) of found candidates (block, part, list, at, pos, entry, whole): entry, plus the one of
    `list` for all that are not whole (null: for all)."""

    def run(batches):
        for row in _each(batches):
            at, pos, score = unpack(row["at"]), unpack(row["pos"]), unpack(row["entry"])
            lacking = np.arange(len(at)) if row["whole"] is None else np.flatnonzero(unpack(row["whole"]) == 0)
            width = min(row["width"], row["c_width"])
            if width and len(lacking):
                a = _vectors(row["parts"], row["width"])[:, :width]
                b = _vectors(row["c_parts"], row["c_width"])[:, :width]
                for i in range(0, len(lacking), 65536):
                    some = lacking[i : i + 65536]
                    score[some] += np.einsum("ij,ij->i", a[at[some]], b[pos[some]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(unpack(row["ids"])[at]), pa.array(unpack(row["c_ids"])[pos]), pa.array(score)], ["q", "vec_id", "score"]
            )

    candidates = parts.select(
        "list", F.col("block").alias("part"), F.col("ids").alias("c_ids"), F.col("parts").alias("c_parts"), F.col("width").alias("c_width")
    )
    asked = found.join(queries, ["list", "block"]).join(candidates, ["list", "part"])
    return asked.mapInArrow(run, "q long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _with_cuts(queries: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
    """Query blocks with the cutoffs (q, cut) of their queries as one packed column."""
    of_block = queries.where("list = 0").select("block", "ids")

    def run(batches):
        for row in _each(batches):
            for i, q in enumerate(unpack(row["ids"])):
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([i]), pa.array([q])], ["block", "at", "q"])

    def packed(batches):
        for row in _each(batches):
            values = pack(np.array([c["cut"] for c in sorted(row["all"], key=lambda c: c["at"])], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([values])], ["block", name])

    placed = of_block.mapInArrow(run, "block long, at long, q long").join(cuts, "q", "left")
    lists = placed.groupBy("block").agg(F.collect_list(F.struct("at", F.coalesce("cut", F.lit(NO_CUT)).alias("cut"))).alias("all"))
    return queries.join(lists.mapInArrow(packed, f"block long, {name} binary"), "block")


def _merged(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates of both lists side by side: (block, part, at, pos, entry, lacks, tops); lacks is 2 for complete scores.

    tops has the at most k best complete scores of each query and block, packed as (at, score) in two halves.
    """

    def run(batches):
        for row in _each(batches):
            keys, entries = [], []
            for j in "01":
                keys.append((unpack(row["at" + j]) << 32) | unpack(row["pos" + j]))
                entries.append(unpack(row["entry" + j]))
            every, index = np.unique(np.concatenate(keys), return_inverse=True)
            total, lacks = np.zeros(len(every), np.int64), np.full(len(every), 3)
            n = len(keys[0])
            np.add.at(total, index, np.concatenate(entries))
            lacks[index[:n]] -= 2  # found in list 0: lacks list 1
            lacks[index[n:]] -= 3  # found in list 1: lacks list 0
            lacks[lacks == -2] = 2
            at = every >> 32
            whole = np.flatnonzero(lacks == 2)
            order = whole[np.lexsort((-total[whole], at[whole]))]
            first = np.r_[True, np.diff(at[order]) != 0] if len(order) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
            top = order[np.arange(len(order)) - begin < k]
            ids = unpack(row["ids"])
            out = (row["block"], row["part"], pack(at), pack(every & 0xFFFFFFFF), pack(total), pack(lacks), ids[at[top]].tolist(), total[top].tolist())
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(out, types)], ["block", "part", "at", "pos", "entry", "lacks", "top_q", "top_score"]
            )

    sides = [
        found.where(F.col("list") == j).select("block", "part", *[F.col(c).alias(f"{c}{j}") for c in ("at", "pos", "entry")]) for j in (0, 1)
    ]
    ids = queries.where("list = 0").select("block", "ids")
    schema = "block long, part long, at binary, pos binary, entry binary, lacks binary, top_q array<long>, top_score array<long>"
    return sides[0].join(sides[1], ["block", "part"]).join(ids, "block").mapInArrow(run, schema)


def _still_possible(merged: DataFrame, cuts: DataFrame) -> DataFrame:
    """What can reach the raised cutoff, filed under the list that has to complete it (complete scores under list 0)."""

    def run(batches):
        for row in _each(batches):
            at, pos, entry, lacks = (unpack(row[c]) for c in ("at", "pos", "entry", "lacks"))
            first, raised = unpack(row["cuts"])[at], unpack(row["raised"])[at]
            # a missing entry e has LISTS * e < first
            most = np.where(lacks == 2, entry, entry + -(-first // LISTS) - 1)
            keep = most >= raised
            for j in range(LISTS):
                some = np.flatnonzero(keep & ((lacks == j) | ((lacks == 2) & (j == 0))))
                if len(some):
                    values = (row["block"], row["part"], j, pack(at[some]), pack(pos[some]), pack(entry[some]), pack(lacks[some] == 2))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v]) for v in values], ["block", "part", "list", "at", "pos", "entry", "whole"]
                    )

    return merged.join(cuts, "block").mapInArrow(run, _FOUND + ", whole binary")


def top_products(vectors: DataFrame, store: Store, scale: int = 64, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to the smaller vec_id.

    Queries are the vectors whose vec_id is divisible by `every`, candidates all others. `vectors` has vec_id
    and embedding; other columns are not read. Vectors that are null or hold a null, NaN or infinite component and
    rows without a vec_id take no part. Rows that share a vec_id are one vector, the smallest of them. Where two
    vectors differ in length the shorter one ends in zeros, so an empty vector scores 0. Scaled components beyond
    2**26 count as 2**26. An empty table gives no rows.
    """
    rows = (
        vectors.where(F.col("vec_id").isNotNull() & is_finite(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )
    rows = store.save(rows, "int-vectors")
    equal = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1)
    asked = rows.where(F.col("vec_id") % every == 0)
    # equal queries are asked once, under the smallest of their ids
    classes = store.save(asked.groupBy("v").agg(F.min("vec_id").alias("q")), "query-vectors")
    members = asked.join(classes, "v").select("q", F.col("vec_id").alias("query_id"))

    parts = store.save(_blocks(few, "vec_id", ROWS), "candidate-blocks")
    queries = store.save(_blocks(classes, "q", QUERIES), "query-blocks")
    held = parts.count()
    tasks = max(held, rows.sparkSession.sparkContext.defaultParallelism)
    most = max(2, -(-4 * k * LISTS // max(held, 1)))

    local = store.save(_over_pairs(queries, parts, tasks, _largest(most), _FOUND), "local-entries")
    other = local.withColumn("list", 1 - F.col("list")).withColumn("whole", F.lit(None).cast("binary"))
    known = _completed(other, queries, parts).distinct()
    cuts = store.save(_best(known, k + 1).where(F.col("place") == k + 1).select("q", F.col("score").alias("cut")), "cutoffs")

    told = store.save(_with_cuts(queries, cuts, "cuts"), "query-blocks-cut")
    found = store.save(_over_pairs(told, parts, tasks, _reaching, _FOUND), "entries")
    merged = store.save(_merged(found, queries, k + 1), "candidates")
    tops = merged.select(F.explode(F.arrays_zip("top_q", "top_score")).alias("t")).select(
        F.col("t.top_q").alias("q"), F.col("t.top_score").alias("score"), F.lit(0).alias("vec_id")
    )
    better = _best(tops, k + 1).where(F.col("place") == k + 1).select("q", F.col("score").alias("better"))
    raised = cuts.join(better, "q", "left").select("q", F.greatest("cut", "better").alias("cut"))
    limits = _with_cuts(told, raised, "raised").where("list = 0").select("block", "cuts", "raised")
    left = store.save(_still_possible(merged, limits), "possible")
    full = _best(_completed(left, queries, parts), k + 1).select("q", "vec_id", "score")

    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        members.join(full, "q")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
