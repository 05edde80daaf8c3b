"""Near duplicates by SimHash, with candidate keys from the binary Golay code.

Two 64-bit fingerprints that differ in at most 3 bits have, of three segments (21, 21 and 22 bits), at
least two that differ in at most one bit each. A segment, filled up with zeros to 23 bits, lies
within distance 3 of exactly one codeword of the perfect (23, 12) Golay code. If u and v differ in one bit,
the codeword of u lies within distance 4 of v: for v at distance 3 of its own codeword these are 6
codewords, otherwise its own alone. So each fingerprint is filed under one pair of codeword indices
per pair of segments and looked up under the 1 to 36 pairs near it; no linked pair is missed.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import components, keep_rows, on_slices, text_key
from packetloom.store import Store

GENERATOR = 0b101011100011  # of the Golay code, fixed
SHIFTS, WIDTHS = (0, 21, 42), (21, 21, 22)
PAIRS = ((0, 1), (0, 2), (1, 2))
SHINGLE, SEED, BLOCK = 3, 42, 1 << 16


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles of a whole text; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.array([digest(line[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, fp) for every row of `docs`."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_key"), pa.array(fps, pa.int64())], ["doc_id", "_key", "fp"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("_key"), "text")
    return rows.mapInArrow(on_slices("text", run), "doc_id long, _key long, fp long")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Per 11-bit syndrome: the error patterns of weight up to 4 that have it, lightest first, and their number."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    single = [syndrome(1 << b) for b in range(23)]
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s ^= single[b]
                e |= 1 << b
            # beside a leader of weight 0 to 2 there are no patterns of weight 4: the code has distance 7
            patterns[s].append(e)
    counts = np.array([len(p) for p in patterns], np.int64)
    return np.array([p + p[:1] * (6 - len(p)) for p in patterns], np.int64), counts


def _syndromes(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= (v >> bit & 1) * (GENERATOR << (bit - 11))
    return v


def near_codewords(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within distance 4 of each 23-bit vector, its own first, and how many."""
    patterns, counts = golay()
    s = _syndromes(segments)
    return (segments[:, None] ^ patterns[s]) >> 11, counts[s]


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [(u >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]


def bucket_keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): one key per pair of segments to file under, or all keys to look up."""
    near = [near_codewords(s) for s in _segments(fps)]
    rows, keys = [], []
    for kind, (i, j) in enumerate(PAIRS):
        width = 6 if probe else 1
        left, right = near[i][0][:, :width, None], near[j][0][:, None, :width]
        key = kind << 24 | left << 12 | right
        valid = (np.arange(width)[None, :, None] < near[i][1][:, None, None]) & (
            np.arange(width)[None, None, :] < near[j][1][:, None, None]
        )
        rows.append(np.nonzero(valid)[0])
        keys.append(key[valid])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def _keyed(nodes: DataFrame, probe: bool, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            all_fps = batch.column("fp").to_numpy()
            for at in range(0, len(all_fps), 4096):
                fps = np.ascontiguousarray(all_fps[at : at + 4096])
                rows, keys = bucket_keys(fps, probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["bucket", name])

    return nodes.select("fp").mapInArrow(run, f"bucket int, {name} long")


def _differing(u: str, v: str, segment: int | None = None) -> Column:
    x = F.col(u).bitwiseXOR(F.col(v))
    if segment is not None:
        x = F.shiftrightunsigned(x, SHIFTS[segment]).bitwiseAND(F.lit((1 << WIDTHS[segment]) - 1))
    return F.bit_count(x)


def links(nodes: DataFrame) -> DataFrame:
    """Every pair (a, b) of distinct fingerprints that differ in at most 3 bits, once.

    `nodes` has distinct `fp`. A pair meets under several keys; it counts only under the first pair
    of segments that both differ in at most one bit, where it meets exactly once.
    """
    filed, looked_up = _keyed(nodes, False, "a"), _keyed(nodes, True, "b")
    # a fingerprint is looked up under some 85 keys, which Spark's estimate from its table does not know: it would broadcast them
    filed = filed.hint("merge")
    d = [_differing("a", "b", s) <= 1 for s in range(3)]
    kind = F.shiftrightunsigned(filed["bucket"], 24)
    first = F.when(d[0] & d[1], 0).when(d[0] & d[2], 1).when(d[1] & d[2], 2)
    return filed.join(
        looked_up,
        (filed["bucket"] == looked_up["bucket"])
        & (F.col("a") < F.col("b"))
        & (_differing("a", "b") <= 3)
        & (kind == first),
    ).select("a", "b")


def near_groups(docs: DataFrame, store: Store) -> DataFrame:
    """One row per row of `docs`: doc_id, _key, fingerprint (hex), component_id.

    component_id is the smallest doc_id reachable over links of at most 3 differing bits; null doc_ids
    do not count (null if there is no other). Null and empty texts have fingerprint 0 and are linked
    like any other. Other columns of `docs` are not read.
    """
    marked = store.save(fingerprints(docs), "fingerprints")
    nodes = store.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(nodes), store)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    placed = store.save(placed, "placed-fingerprints")
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root")
    named = placed.join(ids, placed["root"] == ids["_root"]).select(F.col("fp").alias("_fp"), "component_id")
    named = store.save(named, "named-fingerprints")
    return marked.join(named, marked["fp"] == named["_fp"]).select(
        "doc_id", "_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, store: Store) -> DataFrame:
    """`docs` with one row per group, the one of smallest doc_id. Groups without any doc_id stay as they are."""
    groups = near_groups(docs, store)
    return keep_rows(docs, groups.where("doc_id = component_id or component_id is null"))
