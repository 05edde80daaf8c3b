"""Removes every word inside a window of words that also occurs elsewhere, by super-k-mer partitioning.

A window's minimiser is the run of MMER words with the least hash in it. Consecutive windows that share
one form a super-k-mer. Equal windows have equal minimisers, so a minimiser selected at one place
only rules its windows out; the counts of minimisers decide which super-k-mers travel at all. Those
travel as one packed string each to the bucket of their minimiser, where the distinct windows are
sorted and counted by full comparison.

Skew: whole texts that occur more than once are settled by their digest and only one of them travels.
A bucket with more than BUCKET_WINDOWS windows is cut into shards by place of origin; its shards report one row
per distinct window, and an aggregate with map-side combining adds them up.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import on_slices, same, span_hashes, text_key
from packetloom.store import Store

WINDOW = 35
MMER = 8
BUCKET_WINDOWS = 4_096
RUN_WINDOWS = 1_024  # a longer super-k-mer (of a text that repeats itself) is cut; this bounds one string
FLUSH = 20_000


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    span, least = 1, keys
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def super_kmers(lines: list[bytes], counts: np.ndarray, window: int = WINDOW, mmer: int = MMER):
    """Of texts with at least `window` words, joined by one space: (line, minimiser, start, windows, places)."""
    line = np.frombuffer(b"\n".join(lines), np.uint8)
    gaps = np.flatnonzero((line == 32) | (line == 10))
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))
    values = span_hashes(line, starts[: len(starts) - mmer + 1], ends[mmer - 1 :])
    # the position in the low half makes the leftmost of equal values the least
    order = values & np.uint64(0xFFFFFFFF00000000) | np.arange(len(values), dtype=np.uint64)
    place = (sliding_min(order, window - mmer + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(lines)), counts)
    at = np.flatnonzero(owner[: len(place)] == owner[window - 1 :])
    place = place[at]
    value = values[place]
    apart = np.diff(at) != 1
    new_run = np.concatenate(([True], apart | (value[1:] != value[:-1])))
    new_place = np.concatenate(([True], apart | (place[1:] != place[:-1])))
    first = np.flatnonzero(new_run)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(inside % RUN_WINDOWS == 0)
    line_of = owner[at[first]]
    new_place[first] = True
    return (
        line_of,
        value[first].view(np.int64),
        (at[first] - (np.cumsum(counts) - counts)[line_of]).astype(np.int32),
        np.diff(np.append(first, len(at))).astype(np.int32),
        np.add.reduceat(new_place.astype(np.int32), first, dtype=np.int32),
    )


_RUNS = "runs array<struct<minimiser: long, start: int, windows: int, places: int>>"
_ROW = [pa.field("doc_id", pa.int64()), pa.field("_key", pa.int64())]


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = [t.split() if t else [] for t in batch.column("text").cast(pa.binary()).to_pylist()]
    counts = np.array([len(w) for w in words], np.int64)
    lines = [b" ".join(w) for w in words]
    del words
    digests = [hashlib.sha256(x).digest() for x in lines]
    long = np.flatnonzero(counts >= WINDOW)
    per_row = np.zeros(len(lines) + 1, np.int32)
    fields = [np.zeros(0, np.int64), *[np.zeros(0, np.int32)] * 3]
    if len(long):
        owner, *fields = super_kmers([lines[i] for i in long], counts[long])
        per_row[1:] = np.bincount(long[owner], minlength=len(lines))
    runs = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["minimiser", "start", "windows", "places"])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("_key"),
            pa.array(counts),
            pa.array(digests, pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.cumsum(per_row), pa.int32()), runs),
        ],
        ["doc_id", "_key", "n_words", "digest", "runs"],
    )


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = [[] for _ in range(6)]
    rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_key", "runs")))
    for (doc_id, key, runs), text in zip(rows, batch.column("text").cast(pa.binary()).to_pylist()):
        words = text.split()
        for r in runs:
            start = r["start"]
            shard = hash((doc_id, key, start)) % r["shards"]
            packed = b" ".join(words[start : start + r["windows"] + WINDOW - 1])
            for column, value in zip(out, (r["minimiser"], shard, r["shards"] > 1, doc_id, key, (start, packed))):
                column.append(value)
    starts, packed = zip(*out[5]) if out[5] else ((), ())
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = ["minimiser", "shard", "sharded", "doc_id", "_key", "start", "packed"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*out[:5], starts, packed], types)], names)


_FOUND = "doc_id long, _key long, begin int, stop int, window binary, occurrences int"


def count_windows(rows: list[tuple], sharded: bool):
    """Rows (doc_id, _key, start, packed) of one bucket or shard: the spans to remove as _FOUND rows.

    Of a shard, also one row per distinct window with its digest, to be added up over the shards.
    """
    places: dict[bytes, list[tuple]] = {}
    for doc_id, key, start, packed in rows:
        places.setdefault(packed, []).append((doc_id, key, start))
    windows = []
    for packed in places:
        ends = [i for i, c in enumerate(packed) if c == 32] + [len(packed)]
        starts = [0, *(e + 1 for e in ends[:-1])]
        windows += [(packed[starts[j] : ends[j + WINDOW - 1]], packed, j) for j in range(len(ends) - WINDOW + 1)]
    marked: dict[bytes, list[int]] = {p: [] for p in places}
    if len(places) == 1 and not sharded and len(rows) > 1:
        for _, packed, j in windows:
            marked[packed].append(j)
    else:
        windows.sort()
        for window, equal in groupby(windows, key=lambda w: w[0]):
            equal = list(equal)
            total = sum(len(places[p]) for _, p, _ in equal)
            if total > 1:
                for _, packed, j in equal:
                    marked[packed].append(j)
            if sharded:
                doc_id, key, start = places[equal[0][1]][0]
                at = start + equal[0][2]
                yield doc_id, key, at, at + WINDOW, hashlib.blake2b(window, digest_size=16).digest(), min(total, 2)
    for packed, found in marked.items():
        spans = merged(sorted((j, j + WINDOW) for j in found))
        for doc_id, key, start in places[packed]:
            for begin, stop in spans:
                yield doc_id, key, start + begin, start + stop, None, 0


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, stop in spans:
        if out and begin <= out[-1][1]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([begin, stop])
    return out


def _count_buckets(batches):
    names = ["minimiser", "shard", "sharded", "doc_id", "_key", "start", "packed"]
    rows = (row for b in batches for row in zip(*(b.column(n).to_pylist() for n in names)))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())

    def batch(found):
        columns = zip(*found) if found else [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            ["doc_id", "_key", "begin", "stop", "window", "occurrences"],
        )

    found: list[tuple] = []
    for (_, _, sharded), bucket in groupby(rows, key=lambda r: r[:3]):
        found += count_windows([r[3:] for r in bucket], sharded)
        if len(found) >= FLUSH:
            yield batch(found)
            found = []
    yield batch(found)


def _remove(batch: pa.RecordBatch) -> pa.RecordBatch:
    removed, digests = [], []
    for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
        words = text.split()
        spans = merged(sorted((s["begin"], s["stop"]) for s in spans))
        for begin, stop in reversed(spans):
            del words[begin:stop]
        removed.append(sum(stop - begin for begin, stop in spans))
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("_key"), pa.array(removed, pa.int64()), pa.array(digests)],
        ["doc_id", "_key", "n_removed", "kept_sha256"],
    )


def remove_repeats(docs: DataFrame, store: Store) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256.

    Windows are judged on the input. Null and empty texts, and texts with fewer words than a window, lose nothing.
    Rows that repeat entirely count as occurrences of each other. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("_key"), "text")
    scanned = store.save(
        texts.mapInArrow(on_slices("text", _scan), f"doc_id long, _key long, n_words long, digest binary, {_RUNS}"), "super-kmers"
    )
    one = F.struct("doc_id", "_key")
    whole = (
        scanned.where(F.col("n_words") >= WINDOW)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("first"))
        .where("n > 1")
        .withColumnRenamed("digest", "_digest")
    )
    # stored, so that both sides of the join are shuffled for it and a hot digest can be split
    whole = store.save(whole, "whole-texts")
    copies = store.save(
        scanned.select("doc_id", "_key", "digest")
        .join(whole, F.col("digest") == F.col("_digest"))
        .select("doc_id", "_key", (one == F.col("first")).alias("travels"))
        .distinct(),
        "whole-copies",
    )

    runs = scanned.select("doc_id", "_key", F.inline("runs"))
    shared = (
        runs.groupBy("minimiser")
        .agg(F.sum("places").alias("places"), F.sum("windows").alias("n"))
        .where("places > 1")
        .select(F.col("minimiser").alias("_m"), F.ceil(F.col("n") / BUCKET_WINDOWS).cast("int").alias("shards"))
    )
    shared = store.save(shared, "shared-minimisers")  # as above, for a hot minimiser
    candidates = runs.join(shared, runs["minimiser"] == shared["_m"]).select(
        "doc_id", "_key", "minimiser", "start", "windows", "shards"
    )
    per_row = candidates.groupBy("doc_id", "_key").agg(
        F.collect_set(F.struct("minimiser", "start", "windows", "shards")).alias("runs")
    )
    idle = copies.where("not travels").select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"))
    per_row = per_row.join(idle, same(F.col("doc_id"), F.col("_i")) & (F.col("_key") == F.col("_k")), "left_anti")
    per_row = per_row.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"), "runs")
    travelling = store.save(
        texts.join(per_row, same(texts["doc_id"], F.col("_i")) & (texts["_key"] == F.col("_k"))).select(
            "doc_id", "_key", "text", "runs"
        ),
        "travelling",
    )
    packed = travelling.mapInArrow(
        on_slices("text", _packed),
        "minimiser long, shard int, sharded boolean, doc_id long, _key long, start int, packed binary",
    )
    bucketed = packed.repartition("minimiser", "shard").sortWithinPartitions("minimiser", "shard")
    found = store.save(bucketed.mapInArrow(_count_buckets, _FOUND), "found-windows")

    across = found.where("window is not null")
    again = across.groupBy("window").agg(F.sum("occurrences").alias("n")).where("n > 1").select(F.col("window").alias("_w"))
    late = across.where("occurrences = 1").join(again, F.col("window") == F.col("_w"))
    spans = found.where("window is null").select("doc_id", "_key", "begin", "stop").union(
        late.select("doc_id", "_key", "begin", "stop")
    )
    spans = spans.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    gone = copies.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"))
    spans = spans.join(gone, same(F.col("doc_id"), F.col("_i")) & (F.col("_key") == F.col("_k")), "left_anti")
    spans = spans.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"), "spans")
    cut = (
        travelling.select("doc_id", "_key", "text")
        .join(spans, same(F.col("doc_id"), F.col("_i")) & (F.col("_key") == F.col("_k")))
        .select("doc_id", "_key", "text", "spans")
        .mapInArrow(on_slices("text", _remove), "doc_id long, _key long, n_removed long, kept_sha256 string")
    )
    settled = cut.union(copies.select("doc_id", "_key", F.lit(None).cast("long"), F.sha2(F.lit(""), 256)))
    settled = settled.toDF("_i", "_k", "n_removed", "kept_sha256")
    settled = store.save(settled.distinct(), "settled")
    return scanned.join(settled, same(F.col("doc_id"), F.col("_i")) & (F.col("_key") == F.col("_k")), "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("_k").isNull(), 0).otherwise(F.coalesce("n_removed", "n_words")).alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"),
    )
