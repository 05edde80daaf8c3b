"""Pieces the operators share: table reads, bounded slices of Arrow batches, row recovery, components."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.store import Store

#: Text bytes that one task holds in unpacked form at a time. It bounds memory, not results.
SLICE_BYTES = 1_000_000
#: Bytes of an Arrow batch on its way to a Python worker, about. By rows alone, 10,000 long texts travel in one.
BATCH_BYTES = 4_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
REMOVE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LONG_PIECE = 64  # a longer piece of text is encoded and forgotten
BASE = 0x9E3779B97F4A7C15  # odd, of the polynomial hash of byte spans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python workers are cut by their bytes too, unless the session already says how. It bounds memory, not results."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go with the query that wrote them, unless the session already says how; otherwise they stay until the
    driver collects its garbage. For work of which every step is stored."""
    said = spark.conf.get(REMOVE_SETTING, None)
    if said is None:
        spark.conf.set(REMOVE_SETTING, "true")
    try:
        yield
    finally:
        if said is None:
            spark.conf.unset(REMOVE_SETTING)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose text in `column` takes `limit` bytes; a longer text stands alone."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def on_slices(column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], limit: int = SLICE_BYTES):
    """A function for mapInArrow that applies `fn` to bounded slices of each batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                out = fn(part)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        steps = np.full(1 << bits, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return up(BASE), up(pow(BASE, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def span_hashes(line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    power, inverse = _powers(max(20, int(len(line)).bit_length()))
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum((line.astype(np.uint64) + np.uint64(1)) * power[: len(line)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


_SPACE_GOES_ON = re.compile(r" (?:\s|\Z)")


def space_pieces(text: str) -> tuple[str, list[str]]:
    """The text cut before each space that a non-space follows: the first piece, and the others without that space.

    The usual pattern of byte-level vocabularies always cuts there, so the tokens of a text are those of its pieces.
    """
    parts = text.split(" ")
    if not _SPACE_GOES_ON.search(text):
        return parts[0], parts[1:]
    first, rest = parts[0], []
    for part in parts[1:]:
        if part and not part[0].isspace():
            rest.append(part)
        elif rest:  # white space goes on: no cut before it
            rest[-1] += " " + part
        else:
            first += " " + part
    return first, rest


def strings(array: pa.Array) -> list[str]:
    """As to_pylist of an array without nulls, which makes a scalar of each value first."""
    return array.to_numpy(zero_copy_only=False).tolist()


def distinct_pieces(cut: Iterable[tuple[str, list[str]]]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Of texts cut by space_pieces: the distinct pieces after a space, the distinct first pieces, the places of all pieces of
    the texts in these two lists one after the other, and how many pieces each text has."""
    heads, chunks = [], []
    for first, rest in cut:
        heads.append(first)
        chunks.append(pa.array(rest, pa.string()))  # the pieces of one text at a time are Python objects
    spaced = pa.chunked_array(chunks, pa.string()).combine_chunks().dictionary_encode()
    firsts = pa.array(heads, pa.string()).dictionary_encode()
    counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
    places = firsts.indices.to_numpy() + np.int32(len(spaced.dictionary))
    index = np.insert(spaced.indices.to_numpy(), np.cumsum(counts) - counts, places)
    return strings(spaced.dictionary), strings(firsts.dictionary), index, counts + 1


def words_in(pattern, spaced: list[str], firsts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of the pieces, those after a space first, and for each piece how many words there are up to its end."""
    words = pattern.findall(" ".join(["", *spaced]))
    in_chars = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    stops = [np.searchsorted(in_chars, np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)) + 1)) + 1]
    for first in firsts:
        words += pattern.findall(first)
        stops.append(np.array([len(words)]))
    return words, np.concatenate(stops)


def gathered(values: np.ndarray, stops: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `values`, run i ending at stops[i]: those of `index` one after another, and where they begin and end (one more than runs)."""
    sizes = np.diff(stops, prepend=0)
    ends = np.concatenate(([0], np.cumsum(sizes[index])))
    at = np.repeat(((stops - sizes)[index] - ends[:-1]).astype(np.int32), sizes[index])
    at += np.arange(len(at), dtype=np.int32)
    return values[at], ends


def per_process(key: tuple, build: Callable[[], object]):
    """What `build` makes, once per Python worker. Functions travel by value, so their own globals are new in each task."""
    kept = sys.modules.setdefault("_packetloom_worker", types.ModuleType("_packetloom_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


class PieceCache:
    """The ids of pieces met lately, as bytes; about `size` of them. It bounds memory and only saves work."""

    def __init__(self, size: int):
        self.half = size // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, pieces: set[str]) -> list[str]:
        """The pieces not known. The others are in `young` afterwards, until the next call."""
        if len(self.young) + len(pieces) > self.half:
            self.old, self.young = self.young, {}
        absent = pieces - self.young.keys()
        back = absent & self.old.keys()
        self.young.update((p, self.old[p]) for p in back)
        return list(absent - back)

    def forget(self, pieces: list[str]) -> None:
        for piece in pieces:
            if len(piece) > LONG_PIECE:
                del self.young[piece]


def same(left: Column, right: Column) -> Column:
    """Equality in which two nulls agree."""
    return left.eqNullSafe(right)


def text_key(text: str = "text") -> Column:
    """With doc_id it names a row: rows that share both are copies of each other in every respect that counts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\x00")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` named by `kept` (doc_id, _key), once each where a row is repeated."""
    keys = kept.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k")).distinct()
    # whole rows travel in one column, so no name of theirs can clash
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_d"), text_key().alias("_t"))
    joined = rows.join(keys, same(F.col("_d"), F.col("_i")) & (F.col("_t") == F.col("_k")))
    return joined.dropDuplicates(["_d", "_t"]).select("_row.*")


def components(links: DataFrame, store: Store) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node it is connected to.

    Alternates the large-star and small-star steps of the published contraction algorithm until the
    edges are stars. Each step is one aggregate and one join on a node, so a hub is an ordinary
    hot key with one row on the other side, which the skew handling of joins splits. Tables are
    written between rounds; only a count and a checksum reach the driver.
    """
    edges = store.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        wide = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        wide = store.save(wide.distinct(), "edges")
        least = wide.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        narrow = (
            wide.join(least, F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
        )
        edges = store.save(narrow.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
