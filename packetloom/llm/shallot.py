"""k-means over integer vectors by Shallot search.

A vector remembers its nearest and its second-nearest centroid, an upper bound of the distance to the first and a
lower bound of the distance to all others. When centroids have moved, the bounds are widened by the moves; only
where they no longer settle the nearest one is it searched for. The search measures the two remembered centroids,
starts from the closer one and goes through the others in the order of their distance from it, up to a ball that
holds everything as near as the second-nearest centroid seen so far; each closer one shrinks the ball. Bounds
are doubles and only decide what is looked at; survivors are compared by integer squared distances.

Vectors, bounds and memory travel together in blocks of rows. A round reads the blocks and writes the next ones with the
sums of their clusters; the driver sees one row of sums per centroid and component, and sends the centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.vectors import is_finite, matrix, pack, scaled, unpack
from packetloom.store import Store

ROWS = 4096
SLACK = 1e-9  # relative, for rounding in the bounds

_STATE = "ids array<long>, vectors binary, near binary, second binary, upper binary, lower binary, sums array<long>, inertia array<long>"


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids with what a search needs: distances between them and, from each, the others in order."""

    def __init__(self, rows: np.ndarray, moves: np.ndarray):
        self.rows, self.moves = rows, moves
        n = len(rows)
        self.apart = np.sqrt(np.array([_squared(rows, rows[i]) for i in range(n)], np.float64).reshape(n, n))
        order = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), self.apart), axis=1)
        self.others = np.array([[j for j in order[i] if j != i] for i in range(n)], np.int64).reshape(n, n - 1)
        self.gap = self.apart[np.arange(n), self.others[:, 0]] if n > 1 else np.full(n, np.inf)
        top = np.argsort(-moves)
        # the furthest move of any centroid but this one
        self.other_move = np.where(np.arange(n) == top[0], moves[top[1]] if n > 1 else 0.0, moves[top[0]])


def _closer(d: np.ndarray, j: np.ndarray, than: np.ndarray, than_j: np.ndarray) -> np.ndarray:
    return (d < than) | ((d == than) & (j < than_j))


def search(vectors: np.ndarray, near: np.ndarray, second: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """(nearest, second-nearest, squared distances to both) of each vector, from two remembered centroids."""
    if len(c.rows) == 1:
        d = _squared(vectors, c.rows[near])
        return near, second, d, np.full(len(d), np.iinfo(np.int64).max)
    d1, d2 = _squared(vectors, c.rows[near]), _squared(vectors, c.rows[second])
    swap = _closer(d2, second, d1, near)
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, known = near.copy(), second.copy()
    reach = np.sqrt(d1.astype(np.float64))
    active = np.arange(len(vectors))
    for place in range(c.others.shape[1]):
        j = c.others[start[active], place]
        ball = (reach[active] + np.sqrt(d2[active].astype(np.float64))) * (1 + SLACK) + SLACK
        inside = c.apart[start[active], j] <= ball  # all later centroids are further away still
        active, j = active[inside], j[inside]
        if not len(active):
            break
        fresh = j != known[active]
        rows, j = active[fresh], j[fresh]
        d = _squared(vectors[rows], c.rows[j])
        first = _closer(d, j, d1[rows], near[rows])
        won, lost = rows[first], rows[~first]
        second[won], d2[won] = near[won], d1[won]
        near[won], d1[won] = j[first], d[first]
        behind = _closer(d[~first], j[~first], d2[lost], second[lost])
        second[lost[behind]], d2[lost[behind]] = j[~first][behind], d[~first][behind]
    return near, second, d1, d2


def _round(batches, c: Centroids, last: bool):
    n, width = c.rows.shape
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in ("ids", "vectors", "near", "second", "upper", "lower")}
            vectors = unpack(row["vectors"]).reshape(-1, width)
            if row["near"] is None:  # nothing is remembered yet
                near = np.zeros(len(vectors), np.int64)
                second = np.full(len(vectors), min(1, n - 1))
                upper, lower = np.full(len(vectors), np.inf), np.zeros(len(vectors))
            else:
                near, second = unpack(row["near"]).copy(), unpack(row["second"]).copy()
                upper = (np.frombuffer(row["upper"]) + c.moves[near]) * (1 + SLACK)
                lower = (np.frombuffer(row["lower"]) - c.other_move[near]) * (1 - SLACK) - SLACK
            open_ = np.flatnonzero(upper * (1 + SLACK) + SLACK >= np.maximum(lower, (c.gap[near] - upper) * (1 - SLACK)))
            near[open_], second[open_], d1, d2 = search(vectors[open_], near[open_], second[open_], c)
            upper[open_], lower[open_] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
            if last:
                inertia = np.zeros(n, np.int64)
                np.add.at(inertia, near, _squared(vectors, c.rows[near]))
                sums = None
            else:
                inertia = None
                sums = np.zeros((n, width + 1), np.int64)
                np.add.at(sums, near, np.column_stack([vectors, np.ones(len(vectors), np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids").slice(i, 1),
                    batch.column("vectors").slice(i, 1),
                    *[pa.array([x], pa.binary()) for x in (pack(near), pack(second), upper.tobytes(), lower.tobytes())],
                    *[pa.array([None if x is None else x.ravel().tolist()], pa.list_(pa.int64())) for x in (sums, inertia)],
                ],
                ["ids", "vectors", "near", "second", "upper", "lower", "sums", "inertia"],
            )


def _blocks(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                none = [pa.nulls(1, t) for t in [pa.binary()] * 4 + [pa.list_(pa.int64())] * 2]
                ids = pa.array([piece.column("vec_id").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([pack(matrix(piece.column("v")))]), *none],
                    ["ids", "vectors", "near", "second", "upper", "lower", "sums", "inertia"],
                )

    return rows.select("vec_id", "v").mapInArrow(run, _STATE)


def _added(state: DataFrame, column: str) -> np.ndarray:
    """The arrays of all blocks added up: per task first, then place by place."""

    def run(batches):
        total = None
        for batch in batches:
            for value in batch.column(0):
                x = np.array(value.as_py(), np.int64)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "total"])

    rows = state.select(column).mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
    return np.array([r["total"] for r in sorted(rows.collect())], np.int64)


def cluster(
    vectors: DataFrame, store: Store, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2
) -> DataFrame:
    """One row per clustered vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Clustered are embeddings with `width` components, none of them null or non-finite; other rows give no row. The first
    centroids are the k vectors of smallest sha256 of `seed:vec_id` (rows that share an id in the order of
    their components; a null id has none), fewer if there are fewer vectors. Ties go to the smaller centroid,
    an empty cluster keeps its centroid. Repeated rows and a null vec_id count as rows of their own. Scaled
    components beyond 2**26 count as 2**26. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    fit = vectors.where((F.size("embedding") == width) & is_finite(F.col("embedding")))
    fit = fit.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = fit.where("vec_id is not null").select(digest.alias("h"), "vec_id", "v").orderBy("h", "vec_id", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    rows = np.array([r["v"] for r in first], np.int64)
    moves = np.zeros(len(rows))
    state = store.save(_blocks(fit), "vector-blocks")
    for turn in range(rounds + 1):
        c, last = Centroids(rows, moves), turn == rounds
        state = store.save(state.mapInArrow(lambda batches, c=c, last=last: _round(batches, c, last), _STATE), "assigned-blocks")
        if not last:
            sums = _added(state, "sums").reshape(len(rows), width + 1)
            held = np.maximum(sums[:, -1:], 1)
            after = np.where(sums[:, -1:] > 0, sums[:, :-1] // held, rows)
            moves, rows = np.sqrt(_squared(after, rows).astype(np.float64)), after
    inertia = _added(state, "inertia").tolist()
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows.tolist()]

    def members(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                near = unpack(batch.column("near")[i].as_py())
                found = _squared(unpack(batch.column("vectors")[i].as_py()).reshape(-1, width), rows[near])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[i].values,
                        pa.array(near, pa.int32()),
                        pa.array(found),
                        pa.array([inertia[j] for j in near.tolist()], pa.int64()),
                        pa.array([sum(inertia)] * len(near), pa.int64()),
                        pa.array([digests[j] for j in near.tolist()], pa.string()),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return state.select("ids", "vectors", "near").mapInArrow(members, schema)
