"""Benchmark decontamination by template windows.

Numbers, names, units and the capitalised first words of sentences become typed placeholders, so a question
keeps its template when its parameters are changed. Windows of WINDOW tokens are hash-joined between documents and
benchmark items, twice: by their words, so that every verbatim copy is found, and by their template where at least half of
it is words. The words behind the placeholders are the slots: a window whose slots are the same words is a hit by itself;
of the others along one alignment of a document with an item, equal slot words of the item must stand for equal words of
the document. Characters of scripts written without spaces are tokens of their own.

A hit of an item of fewer than LEAST_ITEM tokens is `whole` where it fills whole sentences or lines; texts are dropped for
such an item only then, as its words alone may stand in any text.

A filter of fixed size over the benchmark's windows is broadcast and decides which document windows are
shuffled at all; the join that follows is exact, so a full filter costs time and no results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import mixed, on_slices, same, span_hashes, text_key
from packetloom.store import Store

WINDOW = 13
LEAST_ITEM = 5  # tokens; a shorter item has no template, only its words are searched for
FILTER_BITS = 1 << 24
NUMBER, NAME, UNIT, START = (np.uint64(i) for i in (1, 2, 3, 4))

# Fixed values.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce "
    "ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week "
    "weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kph volt volts watt watts"
).split()


# Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_UNSPACED_LEADS = re.compile(rb"[\xe0-\xe9\xef\xf0]")  # first bytes of such characters, and of some others


def _spaced(text: bytes) -> bytes:
    if not _UNSPACED_LEADS.search(text):
        return text
    return _UNSPACED.sub(r" \1 ", text.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


_CORE = _table((48, 57), (65, 90), (97, 122), (128, 255))
_SENTENCE_END = np.isin(np.arange(256), np.frombuffer(b".!?:", np.uint8))


def _lowered(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small letters for ASCII and Latin-1 capitals, and where a capital begins."""
    low, capital = line.copy(), (line >= 65) & (line <= 90)
    low[capital] += 32
    after = np.zeros(len(line), bool)
    after[1:] = (line[:-1] == 0xC3) & (line[1:] >= 0x80) & (line[1:] <= 0x9E) & (line[1:] != 0x97)
    low[after] += 32
    capital[:-1] |= after[1:]
    return low, capital


def _word_hashes(words: list[str]) -> np.ndarray:
    line = np.frombuffer(" ".join(words).encode(), np.uint8)
    gaps = np.flatnonzero(line == 32)
    return np.sort(span_hashes(line, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))))


_NUMBER_HASHES, _UNIT_HASHES = _word_hashes(NUMBER_WORDS), _word_hashes(UNITS)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _joined(text: bytes) -> bytes:
    """The words of a text, with a carriage return for a line break between them and a space for other white space."""
    return b"\r".join(b" ".join(words) for words in map(bytes.split, _spaced(text).splitlines()) if words)


def template(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts in order: (which text, template code, hash of the word, number of its sentence or line over all
    texts). A code below 16 is a placeholder."""
    line = np.frombuffer(b"\n".join(map(_joined, texts)), np.uint8)
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gaps = np.flatnonzero((line == 32) | (line == 10) | (line == 13))
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))
    owner = np.concatenate(([0], np.cumsum(line[gaps] == 10)))

    # first and last byte of each word that is not punctuation
    place = np.arange(len(line))
    core = _CORE[line]
    next_core = np.minimum.accumulate(np.where(core, place, len(line))[::-1])[::-1]
    last_core = np.maximum.accumulate(np.where(core, place, -1))
    filled = starts < ends
    first = np.where(filled, next_core[np.minimum(starts, len(line) - 1)], len(line))
    real = first < ends
    closes = np.zeros(len(starts), bool)
    closes[filled] = _SENTENCE_END[line[ends[filled] - 1]]
    opens = np.concatenate(([True], closes[:-1] | (owner[1:] != owner[:-1])))
    part = np.cumsum(opens | np.concatenate(([True], line[gaps] == 13)))[real]
    opens = opens[real]
    first, owner = first[real], owner[real]
    last = last_core[ends[real] - 1] + 1

    low, capital = _lowered(line)
    word = span_hashes(low, first, last)
    code = np.where(word < 16, word + np.uint64(16), word)
    code[_among(word, _UNIT_HASHES)] = UNIT
    capital = capital[first]
    code[capital & ~opens] = NAME
    code[capital & opens] = START
    digit = (line[first] >= 48) & (line[first] <= 57)
    code[digit | _among(word, _NUMBER_HASHES)] = NUMBER
    return owner, code, word, part


def windows(owner: np.ndarray, code: np.ndarray, length: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first token, hash) of the windows of `length` tokens of one text, at least half of them words; with
    `literal`, where `code` has the hashes of words, of all windows."""
    n = len(code) - length + 1
    if n <= 0 or not (literal or length >= LEAST_ITEM):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.full(n, length + (1 << 32) * literal, np.uint64)
    for i in range(length):
        value = value * np.uint64(0x9E3779B97F4A7C15) + code[i : i + n]
    good = owner[:n] == owner[length - 1 :]
    if not literal:
        words = np.concatenate(([0], np.cumsum(code >= 16)))
        good &= 2 * (words[length:] - words[:n]) >= length
    at = np.flatnonzero(good)
    return at, mixed(value[at])


def _filter_slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(s)) & np.uint64(FILTER_BITS - 1) for s in (0, 20, 40)]


def _whole(at: np.ndarray, part: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows of `length` tokens begin and end with a sentence or line."""
    new = np.concatenate(([True], part[1:] != part[:-1], [True]))[: len(part) + 1]
    return new[at] & new[at + length]


_WINDOW_ROWS = "at int, hash long, kinds array<long>, slots array<long>, whole boolean"


def _window_columns(at, value, first_of, owner, code, word, part, length, literal):
    """Of a literal window all is in the hash; it has no kinds and no slots."""
    kinds, slots = ([[]] * len(at), [[]] * len(at)) if literal else ([], [])
    for a in [] if literal else at.tolist():
        span = slice(a, a + length)
        placeholder = np.flatnonzero(code[span] < 16)
        kinds.append(code[span][placeholder].view(np.int64))
        slots.append(word[span][placeholder].view(np.int64))
    return (
        pa.array((at - first_of[owner[at]]).astype(np.int32)),
        pa.array(value.view(np.int64)),
        pa.array(kinds, pa.list_(pa.int64())),
        pa.array(slots, pa.list_(pa.int64())),
        pa.array(_whole(at, part, length)),
    )


def _rows(batch: pa.RecordBatch, ids: list[str], lengths_of, passes) -> pa.RecordBatch:
    """Windows of the texts of a batch, of the lengths asked for, that pass."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    owner, code, word, part = template([t or b"" for t in texts])
    sizes = np.bincount(owner, minlength=len(texts))
    first_of = np.cumsum(sizes) - sizes
    parts = []
    for length in lengths_of(sizes):
        for literal in (False, True):
            at, value = windows(owner, word if literal else code, length, literal)
            keep = passes(owner[at], sizes, value, length)
            at, value = at[keep], value[keep]
            parts.append((owner[at], _window_columns(at, value, first_of, owner, code, word, part, length, literal)))
    names = [*ids, "tokens", "at", "hash", "kinds", "slots", "whole"]
    tables = [
        pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(rows)) for c in ids), pa.array(sizes[rows], pa.int32()), *columns], names
        )
        for rows, columns in parts
    ]
    return pa.Table.from_batches(tables).combine_chunks()


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, tokens, at, hash, kinds, slots): all windows of the items (item_id, text), by template and by
    words; a short item is one window."""

    def run(batch: pa.RecordBatch):
        def lengths(sizes):
            return sorted({WINDOW, *(int(s) for s in sizes if 0 < s < WINDOW)})

        def passes(rows, sizes, value, length):
            return np.ones(len(rows), bool) if length == WINDOW else sizes[rows] == length

        return _rows(batch, ["item_id"], lengths, passes)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(on_slices("text", run), f"item_id long, tokens int, {_WINDOW_ROWS}")


def _filter_of(found: DataFrame) -> np.ndarray:
    """The bit array over the windows' hashes; its words are put together by an aggregate, at most FILTER_BITS / 64 rows."""

    def run(batches):
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            slot = np.concatenate(_filter_slots(hashes))
            bits = np.uint64(1) << (slot & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], ["w", "b"]
            )

    words = found.select("hash").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def leaks(docs: DataFrame, items: DataFrame, store: Store) -> DataFrame:
    """One row per document and benchmark item that share a window of words, or a template window with consistent slots:
    doc_id, _key, item_id, n_windows (shared ones of the best alignment), item_windows, exact (all slots of the windows
    counted in some alignment are the same words), whole (a window begins and ends with a sentence or line of the document).

    Null and empty texts share nothing. An item of fewer than WINDOW tokens is one window, of fewer than LEAST_ITEM
    only by its words. Repeated rows each count. Other columns are not read.
    """
    known = store.save(benchmark_windows(items.where("text is not null")), "benchmark-windows")
    # window lengths in use: WINDOW and those of short items, fewer than WINDOW in all
    short = [r[0] for r in known.where(F.col("tokens") < WINDOW).select("tokens").distinct().collect()]
    lengths_used = [WINDOW, *sorted(short)]
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(known))

    def run(batch: pa.RecordBatch):
        def passes(rows, sizes, value, length):
            there = np.ones(len(value), bool)
            for slot in _filter_slots(value):
                word = shared.value[(slot >> np.uint64(6)).astype(np.int64)]
                there &= (word >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            return there

        return _rows(batch, ["doc_id", "_key"], lambda sizes: lengths_used, passes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("_key"), "text")
    found = store.save(
        rows.mapInArrow(on_slices("text", run), f"doc_id long, _key long, tokens int, {_WINDOW_ROWS}"), "leak-candidates"
    )
    item = known.select(
        "item_id", F.col("at").alias("item_at"), F.col("hash").alias("_hash"), F.col("kinds").alias("item_kinds"),
        F.col("slots").alias("item_slots"),
    )
    # one row per place of an item; a passage many documents share is a hot key with few rows on this side
    pairs = found.join(item, (F.col("hash") == F.col("_hash")) & (F.col("kinds") == F.col("item_kinds"))).select(
        "doc_id", "_key", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "whole",
        F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("pairs"),
    )
    other = F.when(F.exists("pairs", lambda p: p["i"] != p["d"]), F.col("pairs"))
    aligned = pairs.withColumn("other", other).groupBy("doc_id", "_key", "item_id", "shift").agg(
        F.count_distinct("item_at").alias("n_all"), F.count_distinct(F.when(F.col("other").isNull(), F.col("item_at"))).alias("n_same"),
        F.array_distinct(F.flatten(F.collect_set("other"))).alias("pairs"), F.bool_or("whole").alias("whole"),
    )
    # windows of the same words are hits whatever stands around them, the others only together
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    hits = aligned.select(
        "doc_id", "_key", "item_id", F.when(consistent, F.col("n_all")).otherwise(F.col("n_same")).alias("n_windows"),
        (~consistent | (F.size("pairs") == 0)).alias("exact"), "whole",
    ).where("n_windows > 0")
    sizes = known.groupBy("item_id").agg(F.count_distinct("at").alias("item_windows"), F.max("tokens").alias("item_tokens"))
    sizes = sizes.withColumnRenamed("item_id", "_item")
    return (
        hits.groupBy("doc_id", "_key", "item_id")
        .agg(F.max("n_windows").alias("n_windows"), F.bool_or("exact").alias("exact"), F.bool_or("whole").alias("whole"))
        .join(sizes, same(F.col("item_id"), F.col("_item")))
        .select("doc_id", "_key", "item_id", "n_windows", "item_windows", "exact", "item_tokens", "whole")
    )


def drop_leaks(docs: DataFrame, items: DataFrame, store: Store) -> DataFrame:
    """`docs` without the rows that share a window with an item, all columns as they were.

    For an item of fewer than LEAST_ITEM tokens, rows go where it is whole sentences or lines of the text.
    """
    found = leaks(docs, items, store).where((F.col("item_tokens") >= LEAST_ITEM) | F.col("whole"))
    hit = store.save(found.select("doc_id", "_key").distinct(), "leaking").toDF("_i", "_k")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_d"), text_key().alias("_t"))
    return rows.join(hit, same(F.col("_d"), F.col("_i")) & (F.col("_t") == F.col("_k")), "left_anti").select("_row.*")
