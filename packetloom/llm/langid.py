"""Language identification with bit-sliced Bloom filters of character n-grams.

A slot of the filter is a bit mask with one bit per language, in as many 64-bit words as they need, so one look-up of an n-gram (the AND of its slots)
returns all languages that contain it. Per language the returned bits are counted; the share that a
filter of its fill would return by chance is taken out, and the language with the largest share decides.

Every n-gram of the training texts is in the filter. A language has a bit per level of SHARES: that of the first level for all
its n-grams, that of another for those that make up at least this share of its n-grams of that order. Its share is
the mean over its levels; with one level, an n-gram of a single mislabelled text would count like the commonest. The model, which is
broadcast, is fitted on at most about LABELLED_CHARS code points of labelled texts per language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import on_slices
from packetloom.store import Store

ORDERS = (1, 2, 3)
SHARES = (0.0, 1e-4)
LABELLED_CHARS = 20_000_000  # per language; of a language with more, this part of its texts, chosen by a hash of each row
HASHES = 4
SLOTS_PER_GRAM = 8  # slots per n-gram and language at least
UNKNOWN = "und"
LOW, MARGIN = 0.005, 0.9  # a text is told from junk at MARGIN times the quantile LOW of the shares of its language's texts
ACCURACY = 10_000
BLOCK = 1 << 18


def letter_codes(text: str) -> np.ndarray:
    """Code points of the text in small letters; every run of other characters becomes one space, also at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x2FFFF)]
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return codes[keep].astype(np.uint64)


_LETTER_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER_TABLE:
        _LETTER_TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000))
    return _LETTER_TABLE[0]


def grams(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(order, keys): the n-grams of a text as 64-bit keys, in blocks. Those of white space alone are left out."""
    codes = letter_codes(text)
    for at in range(0, len(codes), BLOCK):
        block = codes[at : at + BLOCK + max(ORDERS) - 1]
        for order in ORDERS:
            n = min(len(block) - order + 1, BLOCK)
            if n <= 0:
                continue
            key = np.full(n, order, np.uint64)
            for i in range(order):
                key = key * np.uint64(0x100000001B3) ^ block[i : i + n]
            if order == 1:
                key = key[block[:n] != 32]
            yield order, (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def labelled(docs: DataFrame) -> DataFrame:
    """(lang, text) of the documents (doc_id, text, lang) to learn from: whole texts, LABELLED_CHARS per language expected at most."""
    known = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    size = known.groupBy(F.col("lang").alias("_l")).agg(F.sum(F.length("text")).alias("size"))  # one row per language
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    met = known.join(F.broadcast(size), F.col("lang") == F.col("_l"))
    return met.where(place * F.col("size") < F.lit(float(LABELLED_CHARS << 30))).select("lang", "text")


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, ord, gram, n) over the labelled documents; added up per slice before the shuffle."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        per: dict[tuple[str, int], list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for order, keys in grams(text):
                per.setdefault((lang, order), []).append(keys)
        columns: list[list] = [[], [], [], []]
        for (lang, order), keys in per.items():
            values, n = np.unique(np.concatenate(keys), return_counts=True)
            columns[0] += [lang] * len(values)
            columns[1].append(np.full(len(values), order, np.int32))
            columns[2].append(values.view(np.int64))
            columns[3].append(n)
        arrays = [
            pa.array(columns[0], pa.string()),
            *(pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64()))),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "ord", "gram", "n"])

    counted = labelled(docs).mapInArrow(on_slices("text", count), "lang string, ord int, gram long, n long")
    return counted.groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # one mask per slot, of one word or a row of words; their number is a power of two
    chance: np.ndarray  # per bit: the probability that it comes back for an n-gram it does not stand for
    least: np.ndarray | None = None  # per language: the share below which a text is none of its texts
    levels: int = 1  # bits of a language, one after the other

    def _slots_of(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        step = keys >> np.uint64(32) | np.uint64(1)
        for i in range(HASHES):
            yield (keys + np.uint64(i) * step) & np.uint64(len(self.slots) - 1)

    def insert(self, keys: np.ndarray, masks: np.ndarray) -> None:
        for slot in self._slots_of(keys):
            np.bitwise_or.at(self.slots, slot.astype(np.int64), masks)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        found = np.full((len(keys), *self.slots.shape[1:]), 2**64 - 1, np.uint64)
        for slot in self._slots_of(keys):
            found &= self.slots[slot.astype(np.int64)]
        return found

    def shares(self, text: str | None) -> np.ndarray | None:
        """Per language the share of the n-grams it holds, less what comes back by chance, as the mean of its levels; None without a letter."""
        if not text or not self.languages or not has_letter(text):
            return None
        hits, total = np.zeros(len(self.chance)), 0
        for _, keys in grams(text):
            words = self.look_up(keys).reshape(len(keys), -1).T
            total += len(keys)
            hits += [np.count_nonzero(words[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(hits))]
        return np.clip((hits / max(total, 1) - self.chance) / (1 - self.chance), 0, 1).reshape(-1, self.levels).mean(axis=1)

    def score(self, text: str | None) -> tuple[str, float]:
        share = self.shares(text)
        if share is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(share))  # of equal ones the first in the order of names
        rest = share.sum()
        return self.languages[best], float(share[best] / rest) if rest else 1 / len(share)

    def told(self, text: str | None) -> bool:
        """Whether some language holds as much of the text as of its own texts."""
        share = self.shares(text)
        return share is not None and bool(((share > 0) & (share >= self.least)).any())


def fit(docs: DataFrame, store: Store) -> LanguageFilter:
    """The filter of the languages of `docs` (doc_id, text, lang), however many.

    What is collected are the distinct n-grams of the labelled texts, which LABELLED_CHARS bounds per language.
    """
    counts = store.save(gram_counts(docs), "gram-counts")
    total = counts.groupBy("lang", "ord").agg(F.sum("n").alias("of"))  # one row per language and order
    total = total.select(F.col("lang").alias("_l"), F.col("ord").alias("_o"), "of")
    rows = counts.join(F.broadcast(total), (F.col("lang") == F.col("_l")) & (F.col("ord") == F.col("_o")))
    reached = sum((F.col("n") >= F.col("of") * share).cast("int") for share in SHARES)  # SHARES grow, so levels are nested
    table = rows.select("lang", "gram", reached.alias("reached")).toArrow()
    names = table["lang"].combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    levels = len(SHARES)
    position = np.array([languages.index(x) for x in names.dictionary.to_pylist()], np.int64)
    number, reached = position[names.indices.to_numpy()], table["reached"].to_numpy()
    keys = table["gram"].to_numpy().astype(np.int64).view(np.uint64)
    most = int(np.bincount(number, minlength=1).max()) if len(number) else 1
    slots, bits = 1 << math.ceil(math.log2(max(64, SLOTS_PER_GRAM * most))), len(languages) * levels
    # a word after the other stands together in memory
    filters = LanguageFilter(languages, np.zeros((max(1, -(-bits // 64)), slots), np.uint64).T, np.zeros(bits), levels=levels)
    for level in range(levels):
        bit = number * levels + level
        for word in range(filters.slots.shape[1]):
            mine = (bit // 64 == word) & (reached > level)
            one = LanguageFilter(languages, filters.slots[:, word], filters.chance)
            one.insert(keys[mine], np.uint64(1) << (bit[mine] % 64).astype(np.uint64))
    fill = [np.count_nonzero(filters.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / slots for i in range(bits)]
    return replace(filters, chance=np.array(fill) ** HASHES)


def identify(docs: DataFrame, filters: LanguageFilter) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score (0 to 1), from the whole text alone.

    `und` with score 0 for null texts and texts without a letter. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t) for t in batch.column("text").to_pylist()]
        arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(on_slices("text", run), "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    """True for documents that take no part in training: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_least(docs: DataFrame, filters: LanguageFilter) -> LanguageFilter:
    """`filters` with the least shares, from the documents (text, lang) of its languages; one row per language is collected."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        position = {lang: i for i, lang in enumerate(shared.value.languages)}
        rows = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            share = shared.value.shares(text) if lang in position else None
            if share is not None:
                rows.append((lang, float(share[position[lang]])))
        arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "share"])

    known = docs.where("text is not null and lang is not null").select("lang", "text")
    low = known.mapInArrow(on_slices("text", run), "lang string, share double").groupBy("lang")
    found = dict(tuple(r) for r in low.agg(F.percentile_approx("share", F.lit(LOW), F.lit(ACCURACY))).collect())
    return replace(filters, least=np.array([MARGIN * found.get(lang, 0.0) for lang in filters.languages]))


def keep_identified(docs: DataFrame, filters: LanguageFilter) -> DataFrame:
    """`docs` without the rows of which no language holds as much as of its own texts, all columns as they were.

    What is asked for is absolute, so it does not depend on how many languages there are or how alike they are. Where
    `filters` has no least shares, they come from `docs`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters if filters.least is not None else with_least(docs, filters))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([shared.value.told(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(on_slices("text", run), docs.schema)
