"""Flow embeddings, exact nearest neighbours, and counterfactuals.

Nearest neighbours are by cosine similarity, reported and ranked at six decimals, then by id. Equal
vectors are searched once, and at most k base rows per vector can ever be among the best k, so
copies cost nothing. Two exact ways, chosen by a size check:

* few base vectors: they are broadcast, and queries are compared where they lie;
* otherwise base vectors are cut into cells around pivots and into bands by distance to the
  pivot. The triangle inequality tells which bands can hold a neighbour. A first round searches the
  nearest bands of a query, a second one the bands its k-th best still allows. Bands and their
  visitors are cut into blocks of bounded size, so no task holds a whole band. Where vectors are so spread
  that the second round would move more rows than a grid of all pairs of blocks, the grid is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.identity import counterfactual_id
from packetloom.functions.narrative import narrative
from packetloom.functions.vectors import l2_normalise, weighted_sum
from packetloom.operators.stats import NormStats, normalise
from packetloom.schemas import FEATURES
from packetloom.store import Store

# Embedding size, projection seed, digits of the similarity, cap of a percentage.
EMBEDDING_DIM = 16
PROJECTION_SEED = 42
DIGITS = 6
PCT_CAP = 99999.99

_SCALE = 10**DIGITS
_BAND = 0.05  # width of a band; unit vectors are at most 2 apart, so a cell has at most 41 bands
MAX_CELLS = 4096
_BOUND_VALUES = 1_000_000  # numbers of an array of bounds or similarities in a task at a time
_ROUTED_ROWS = 4096  # routed vectors handed on at a time
_BLOCKS = 64  # blocks of a table, about, until they are full
_GRID_ROWS = (8192, 32768)  # least and most rows of a block of the grid
_SLACK = 4e-6  # covers the rounding of similarities when distances are compared


def projection(n_features: int = len(FEATURES), dim: int = EMBEDDING_DIM) -> np.ndarray:
    """Gaussian projection with unit columns, the same on every run."""
    matrix = np.random.default_rng(PROJECTION_SEED).standard_normal((n_features, dim))
    return matrix / np.linalg.norm(matrix, axis=0, keepdims=True)


def feature_embeddings(flows: DataFrame, dim: int = EMBEDDING_DIM, fitted: NormStats | None = None) -> DataFrame:
    """z-scored features, projected and scaled to unit length."""
    scaled = normalise(flows.select("flow_id", "label", *FEATURES), FEATURES, fitted)
    columns = [F.col(f) for f in FEATURES]
    raw = [weighted_sum(columns, list(w)) for w in projection(len(FEATURES), dim).T]
    parts = [F.col(f"_raw{i}") for i in range(dim)]
    out = scaled.select("flow_id", "label", *[r.alias(f"_raw{i}") for i, r in enumerate(raw)])
    # a plain sum stays in generated code; plain divisions would make its method too long to be compiled
    length = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in parts]))
    length = F.when(length == 0, F.lit(1.0)).otherwise(length)
    unit = F.zip_with(F.array(*parts), F.array_repeat(length, dim), lambda x, n: x / n)
    return out.select("flow_id", "label", unit.alias("embedding"))


def wrong_dimension(embeddings: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector does not have the expected size."""
    return embeddings.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim)


# --- nearest neighbours ---------------------------------------------------------------------


def _unit(df: DataFrame, key: str) -> DataFrame:
    """Id, unit vector, and a digest that stands for the vector in shuffles."""
    unit = df.select(F.col(key).cast("string").alias("id"), l2_normalise("embedding", 1e-300).alias("vec"))
    return unit.withColumn("vkey", F.md5(F.col("vec").cast("string")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _best(queries: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scaled similarities of the k best base rows; base is in id order, which breaks ties."""
    n = len(base)
    k = min(k, n)
    sims = queries @ base.T
    sims *= _SCALE
    np.rint(sims, out=sims)
    if k == 1:
        at = sims.argmax(axis=1)[:, None]  # the first of equals
    elif k == n:
        at = np.tile(np.arange(n), (len(queries), 1))
    else:
        # whole numbers below 2^53: similarity first, position second, so no two keys are equal
        keys = sims * n
        keys += np.arange(n - 1, -1, -1)
        at = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    return at, np.take_along_axis(sims, at, axis=1).astype(np.int64)


def _pairs(vkeys: pd.Series, ids: np.ndarray, at: np.ndarray, scaled: np.ndarray) -> pd.DataFrame:
    k = at.shape[1]
    return pd.DataFrame(
        {
            "vkey": np.repeat(vkeys.to_numpy(dtype=object), k),
            "neighbour": ids[at.ravel()],
            "scaled": scaled.ravel(),
        }
    )


_RESULT = "vkey string, neighbour string, scaled long"


def _compare(k: int):
    """Best base rows of a block for each query of a block; similarities are held for a part of the queries at a time."""

    def run(key, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame(
            {"vkey": np.array([], dtype=object), "neighbour": np.array([], dtype=object), "scaled": np.array([], dtype="int64")}
        )
        if not len(q) or not len(b):
            return nothing
        b = b.sort_values("id", kind="stable")
        ids, matrix = b["id"].to_numpy(dtype=object), _matrix(b["vec"])
        step = max(1, _BOUND_VALUES // len(ids))
        parts = [q.iloc[lo : lo + step] for lo in range(0, len(q), step)]
        return pd.concat([_pairs(part["vkey"], ids, *_best(_matrix(part["vec"]), matrix, k)) for part in parts])

    return run


def _grid_side(n: int) -> int:
    """Blocks into which n rows are cut for the grid."""
    least, most = _GRID_ROWS
    return max(1, -(-n // max(least, min(most, n // 32))))


def _grid_search(vectors: DataFrame, base: DataFrame, k: int, n_queries: int, n_base: int) -> DataFrame:
    """Every block of queries meets every block of base vectors in a group of its own."""
    i, j = _grid_side(n_queries), _grid_side(n_base)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vkey", "vec", F.pmod(F.xxhash64("vkey"), F.lit(i)).cast("int").alias("i"), every(j).alias("j"))
    right = base.select("id", "vec", every(i).alias("i"), F.pmod(F.xxhash64("id"), F.lit(j)).cast("int").alias("j"))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_compare(k), _RESULT)


def _broadcast_search(vectors: DataFrame, base_rows: pd.DataFrame, k: int) -> DataFrame:
    base_rows = base_rows.sort_values("id", kind="stable")
    shared = vectors.sparkSession.sparkContext.broadcast(
        (base_rows["id"].to_numpy(dtype=object), _matrix(base_rows["vec"]))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        step = max(1, 4_000_000 // len(ids))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.iloc[lo : lo + step]
                yield _pairs(part["vkey"], ids, *_best(_matrix(part["vec"]), matrix, k))

    # comparing costs far more than moving, so a few megabytes of vectors still go to all tasks
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vectors.repartition(tasks).mapInPandas(search, _RESULT)


def _spread_pivots(candidates: np.ndarray, count: int) -> np.ndarray:
    """Greedy farthest-first choice from a bounded sample."""
    chosen = [0]
    nearest = 1 - candidates @ candidates[0]
    while len(chosen) < min(count, len(candidates)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, 1 - candidates @ candidates[chosen[-1]])
    return candidates[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (vectors @ pivots.T), 0.0))


def _cell_search(
    vectors: DataFrame, base: DataFrame, k: int, store: Store, cells: int, block_rows: int
) -> DataFrame:
    sample = base.orderBy("vkey", "id").limit(cells * 8).toPandas()  # cells * 8 rows at most
    pivots = _spread_pivots(_matrix(sample["vec"]), cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(_matrix(batch["vec"]), pivots)
                cell = d.argmin(axis=1)
                r = d[np.arange(len(d)), cell]
                yield batch.assign(cell=cell, band=(r / _BAND).astype(int), r=r)

    vectors = store.save(vectors, "knn_queries")  # read by both rounds
    placed = store.save(
        base.select("id", "vec").mapInPandas(place, "id string, vec array<double>, cell int, band int, r double"), "knn_cells"
    )
    bands = placed.groupBy("cell", "band").agg(
        F.count("*").alias("n"), F.min("r").alias("rmin"), F.max("r").alias("rmax")
    )
    n_queries, n_base = vectors.count(), placed.count()
    # small tables have small blocks, and larger ones not many more of them
    base_rows, visitor_rows = (max(block_rows, min(4096, -(-n // _BLOCKS))) for n in (n_base, n_queries))
    layout = bands.toPandas()  # at most cells * 41 rows, whatever the size of the data
    cell, n = layout["cell"].to_numpy(), layout["n"].to_numpy()
    rmin, rmax = layout["rmin"].to_numpy(), layout["rmax"].to_numpy()
    blocks = np.ceil(n / base_rows).astype(int)
    at_once = max(1, _BOUND_VALUES // max(1, len(layout)))

    def bounds(matrix: np.ndarray) -> np.ndarray:
        """Least distance a member of each band can have from each query."""
        d = _distances(matrix, pivots)
        own = d[:, cell]
        apart = np.maximum(own - rmax, rmin - own)
        return np.maximum(np.maximum(apart, (own - d.min(axis=1, keepdims=True)) / 2), 0.0) - _SLACK

    def first_bands(low: np.ndarray) -> np.ndarray:
        """The nearest bands that together hold k rows."""
        order = np.argsort(low, axis=1, kind="stable")
        held = np.cumsum(n[order], axis=1)
        wanted = np.zeros_like(low, dtype=bool)
        np.put_along_axis(wanted, order, (held - n[order]) < k, axis=1)
        return wanted

    routes_schema = "vkey string, vec array<double>, slot int"

    def routed(part: pd.DataFrame, wanted: np.ndarray) -> Iterator[pd.DataFrame]:
        every_q, every_slot = np.nonzero(wanted)
        for lo in range(0, len(every_q), _ROUTED_ROWS):
            at = part.iloc[every_q[lo : lo + _ROUTED_ROWS]]
            slot = every_slot[lo : lo + _ROUTED_ROWS].astype("int32")
            yield pd.DataFrame({"vkey": at["vkey"].to_numpy(), "vec": at["vec"].to_numpy(), "slot": slot})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), at_once):
                yield batch.iloc[lo : lo + at_once]

    def allowed(part: pd.DataFrame) -> np.ndarray:
        """Bands, without those of the first round, that may hold a neighbour as near as the k-th found."""
        low = bounds(_matrix(part["vec"]))
        kth = np.where(part["found"] >= k, part["kth"], -np.inf)
        reach = np.sqrt(np.maximum(2 - 2 * (kth / _SCALE - _SLACK), 0.0))
        reach[np.isinf(kth)] = np.inf
        return (low <= reach[:, None]) & ~first_bands(low)

    def first_routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches):
            yield from routed(part, first_bands(bounds(_matrix(part["vec"]))))

    def second_routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches):
            yield from routed(part, allowed(part))

    def second_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches):
            yield pd.DataFrame({"copies": [int((allowed(part) @ blocks).sum())]})

    slots = pd.DataFrame({"slot": np.arange(len(layout), dtype="int32"), "cell": cell, "band": layout["band"], "blocks": blocks})
    slot_table = F.broadcast(
        vectors.sparkSession.createDataFrame(slots, "slot int, cell int, band int, blocks int")
    )
    blocked = placed.join(slot_table, ["cell", "band"]).select(
        "id", "vec", "slot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    )

    def search(routes: DataFrame) -> DataFrame:
        routes = store.save(routes, "knn_routes")
        # visitors of a band are cut into chunks as well; the table has one row per band
        visits = routes.groupBy("slot").agg(F.ceil(F.count("*") / F.lit(visitor_rows)).cast("int").alias("chunks"))
        visits = F.broadcast(visits)
        left = (
            routes.join(slot_table.select("slot", "blocks"), "slot")
            .join(visits, "slot")
            .select(
                "vkey",
                "vec",
                "slot",
                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                F.pmod(F.xxhash64("vkey"), F.col("chunks")).cast("int").alias("chunk"),
            )
        )
        right = blocked.join(visits, "slot").select(
            "id", "vec", "slot", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        )
        key = ["slot", "block", "chunk"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_compare(k), _RESULT)
        return store.save(_top(found, k).drop("rank"), "knn_found")

    first = search(vectors.mapInPandas(first_routes, routes_schema))
    reached = first.groupBy("vkey").agg(F.min("scaled").alias("kth"), F.count("*").alias("found"))
    known = vectors.join(reached, "vkey")
    # each query is copied to every block it visits; the grid copies each vector to all blocks of the other side
    copies = known.mapInPandas(second_copies, "copies long").agg(F.sum("copies")).first()[0] or 0
    if copies > n_queries * _grid_side(n_base) + n_base * _grid_side(n_queries):
        return _grid_search(vectors, placed, k, n_queries, n_base)
    second = search(known.mapInPandas(second_routes, routes_schema))
    return first.unionByName(second)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("vkey").orderBy(F.col("scaled").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(
    queries: DataFrame,
    base: DataFrame,
    store: Store,
    k: int = 5,
    key: str = "flow_id",
    exclude_self: bool = False,
    broadcast_values: int = 4_000_000,
    cells: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """The k most similar base rows of each query: (query, neighbour, similarity, rank)."""
    depth = k + 1 if exclude_self else k
    asked = _unit(queries, key)
    # row_number <= depth is cut before the shuffle too, so a vector with many copies stays small
    copies = Window.partitionBy("vkey").orderBy("id")
    kept = (
        _unit(base, key)
        .withColumn("_c", F.row_number().over(copies))
        .where(F.col("_c") <= depth)
        .select("id", "vec", "vkey")
    )
    # one vector per digest; the copies of a hot vector are combined before the shuffle
    vectors = asked.groupBy("vkey").agg(F.first("vec").alias("vec"))
    kept = store.save(kept, "knn_base")
    size = kept.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not size.n:
        found = vectors.sparkSession.createDataFrame([], _RESULT)
    elif size.n * max(1, size.width) <= broadcast_values:
        # checked in numbers, not rows, so long vectors are covered; 4 million doubles are 32 MB
        found = _broadcast_search(vectors, kept.select("id", "vec").toPandas(), depth)
    else:
        # as many cells as a cell has rows, up to what a task can compare each query with
        cells = cells or min(MAX_CELLS, max(16, isqrt(size.n)))
        found = _cell_search(vectors, kept, depth, store, cells, block_rows)
    out = asked.select("id", "vkey").join(_top(found, depth), "vkey").select(
        F.col("id").alias("query"), "neighbour", (F.col("scaled") / F.lit(float(_SCALE))).alias("similarity"), "rank"
    )
    if not exclude_self:
        return out
    out = out.where(F.col("query") != F.col("neighbour"))
    rank = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def nearest_normal(embeddings: DataFrame, store: Store, k: int = 1, **options) -> DataFrame:
    """For each malicious flow, the most similar normal flows."""
    return nearest(embeddings.where("label = 1"), embeddings.where("label = 0"), store, k, **options)


# --- counterfactuals ------------------------------------------------------------------------


def feature_differences(original: str = "a", other: str = "b", features: list[str] | None = None):
    """Array of per-feature differences of two flow structs, largest rounded percentage first."""
    features = features or FEATURES
    items = []
    for position, f in enumerate(features):
        x, y = F.col(f"{original}.{f}").cast("double"), F.col(f"{other}.{f}").cast("double")
        gap = F.abs(x - y)
        base = F.when(x == 0, F.lit(1e-9)).otherwise(F.abs(x))
        pct = F.round(F.least(gap / base * 100, F.lit(PCT_CAP)), 2)
        direction = F.when(y < x, "decrease").when(y > x, "increase").otherwise("unchanged")
        item = F.struct(
            (-pct).alias("order"),
            F.lit(position).alias("position"),
            F.lit(f).alias("feature"),
            x.alias("original_value"),
            y.alias("cf_value"),
            gap.alias("abs_diff"),
            pct.alias("pct_change"),
            direction.alias("direction"),
        )
        items.append(F.when(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y), item))
    ordered = F.array_sort(F.array_compact(F.array(*items)))
    return F.transform(
        ordered,
        lambda d: F.struct(
            *[d[n].alias(n) for n in ("feature", "original_value", "cf_value", "abs_diff", "pct_change", "direction")]
        ),
    )


def counterfactuals(flows: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Malicious flow, its nearest normal flow, what differs, and the story in words."""
    body = F.struct(*FEATURES)
    a = flows.select(F.col("flow_id").alias("query"), body.alias("a"))
    b = flows.select(F.col("flow_id").alias("neighbour"), body.alias("b"))
    joined = neighbours.where(F.col("rank") == 1).join(a, "query").join(b, "neighbour")
    out = joined.select(
        counterfactual_id("query", "neighbour").alias("cf_id"),
        F.col("query").alias("flow_id"),
        F.col("neighbour").alias("nearest_normal_id"),
        F.lit("malicious").alias("prediction"),
        F.lit("normal").alias("cf_prediction"),
        F.col("similarity").alias("similarity_score"),
        feature_differences().alias("feature_diffs"),
        F.array().cast("array<struct<src:string,dst:string>>").alias("edges_removed"),
    )
    return out.withColumn("explanation_text", narrative())


def unmatched(asked: DataFrame, neighbours: DataFrame, cfs: DataFrame) -> DataFrame:
    """Rows in the shape of ``cfs`` for the flows asked about that have no neighbour, as where no flow is normal: nothing to
    compare with, and the text says so."""
    lonely = asked.select("flow_id").join(neighbours.select(F.col("query").alias("flow_id")).distinct(), "flow_id", "left_anti")
    said = {
        "flow_id": F.col("flow_id"),
        "prediction": F.lit("malicious"),
        "explanation_text": F.concat("flow_id", F.lit(": malicious\nno normal flow to compare with")),
    }
    return lonely.select(*[said.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in cfs.schema.fields])


def first_malicious(flows: DataFrame, n: int = 20) -> DataFrame:
    """The first malicious flows in window and edge order."""
    return flows.where("label = 1").orderBy("window_id", "edge_idx").limit(n)


def difference_rows(cfs: DataFrame) -> DataFrame:
    return cfs.select(
        "cf_id", "flow_id", "nearest_normal_id", "similarity_score", F.posexplode("feature_diffs").alias("position", "d")
    ).select("cf_id", "flow_id", "nearest_normal_id", "similarity_score", "position", "d.*")
