"""Token ids of documents in Arrow stream files of equal-size batches.

A file is an Arrow IPC stream whose records are sequences: `ids`, a fixed-size list of LENGTH unsigned
16- or 32-bit ids, and `mask`, a fixed-size list of bits that is 1 where an id is present. Every batch has ROWS
records, the last one padded, and nothing is compressed, so all batch messages of a file have the same
length. Sequence i is at a known offset of batch i // ROWS: a reader maps the file and takes
a view, without reading what comes before. Documents follow one another across sequences; the index
table says where each one starts.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import PieceCache, distinct_pieces, gathered, per_process, space_pieces, words_in
from packetloom.store import Store

LENGTH = 2048
ROWS = 64
END_ID = 0
CACHED_PIECES = 800_000  # pieces whose ids a task remembers; it bounds memory and only saves work
CACHED_WORDS = 400_000  # likewise, words
PENDING_BYTES = 4_000_000
LATIN = "\u0250"  # up to here letters, digits and white space are the same in every version of Unicode in use
#: The usual pattern of byte-level vocabularies.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_level() -> dict[int, int]:
    """The character by which a byte-level vocabulary writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LEVEL = _byte_level()


def schema(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class SequenceWriter:
    """Takes ids in order; `close` pads the last batch."""

    def __init__(self, sink, length: int, rows: int, wide: bool):
        self.schema = schema(length, wide)
        self.length, self.rows = length, rows
        self.dtype = np.uint32 if wide else np.uint16
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.room = np.zeros(length * rows, self.dtype)
        self.used = 0

    def add(self, ids: np.ndarray) -> None:
        while len(ids):
            n = min(len(ids), len(self.room) - self.used)
            self.room[self.used : self.used + n] = ids[:n]
            self.used += n
            ids = ids[n:]
            if self.used == len(self.room):
                self._flush()

    def _flush(self) -> None:
        mask = np.arange(len(self.room)) < self.used
        self.room[self.used :] = 0
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(self.room.copy()), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.used = 0

    def close(self) -> None:
        if self.used:
            self._flush()
        self.stream.close()


class SequenceReader:
    """Random access to the sequences of one file; values are views of the mapped file."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        local = isinstance(system, pafs.LocalFileSystem)
        self.source = pa.memory_map(inner) if local else system.open_input_file(inner)
        self.schema = pa.ipc.read_schema(self.source)
        self.head = self.source.tell()
        self.length = self.schema.field("ids").type.list_size
        self.size = self.source.size() - self.head - 8  # an end mark of 8 bytes follows the batches
        self._batches = lru_cache(maxsize=4)(self._batch)
        if self.size > 0:
            first = pa.ipc.read_message(self.source)
            self.step = self.source.tell() - self.head
            self.rows = pa.ipc.read_record_batch(first, self.schema).num_rows
        else:
            self.step = self.rows = 1
        self.batches = max(self.size, 0) // self.step

    def _batch(self, k: int) -> pa.RecordBatch:
        self.source.seek(self.head + k * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def __len__(self) -> int:
        return self.batches * self.rows

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """ids and mask of sequence i, as Arrow arrays over the mapped file."""
        batch, row = self._batches(i // self.rows), i % self.rows
        return tuple(batch.column(c).values.slice(row * self.length, self.length) for c in (0, 1))

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """n ids from position `start` of the file, in views of at most one batch."""
        per_batch = self.rows * self.length
        while n > 0:
            k, at = divmod(start, per_batch)
            take = min(n, per_batch - at)
            values = self._batches(k).column(0).values.to_numpy()[at : at + take]
            yield values
            start, n = start + take, n - take


class PieceEncoder:
    """Encodes texts with a tokenizer of the `tokenizers` library whose pre-tokeniser is byte-level with its usual pattern.

    The ids of space_pieces do not depend on their neighbours. Pieces not seen lately are cut into words by that pattern, and words not
    seen lately go to the library's model. A piece with letters beyond LATIN goes to the library uncut, so that its own
    tables say what a letter is. A text that names an added token goes there whole, as the token cuts it before the pattern does.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        added = sorted({token.content for token in self.tokenizer.get_added_tokens_decoder().values()})
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.dtype = np.uint32 if self.tokenizer.get_vocab_size() > 65536 else np.uint16
        self.kind = "H" if self.dtype is np.uint16 else "I"
        self.cache, self.words = PieceCache(CACHED_PIECES), PieceCache(CACHED_WORDS)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        spaced, firsts, index, per_text = distinct_pieces(
            (t, []) if t and self.added.search(t) else space_pieces(t or "") for t in texts
        )
        fresh = self.cache.missing(set(spaced))
        known = self.cache.young
        others = [p for p in fresh if not p.isascii() and max(p) >= LATIN]
        latin = list(set(fresh).difference(others))
        known.update(zip(latin, self._by_words(latin)))
        known.update(zip(others, self._library([" " + p for p in others])))
        found = [*map(known.__getitem__, spaced), *self._library(firsts)]
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // np.dtype(self.dtype).itemsize
        flat, ends = gathered(np.frombuffer(b"".join(found), self.dtype), stops, index)
        self.cache.forget(fresh)
        return np.split(flat, ends[np.cumsum(per_text)][:-1]) if texts else []

    def _by_words(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that stand after a space."""
        found, stops = words_in(_WORD, pieces, [])
        fresh = self.words.missing(set(found))
        known = self.words.young
        for word in fresh:
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LEVEL))
            known[word] = array(self.kind, [token.id for token in tokens]).tobytes()
        ids = list(map(known.__getitem__, found))
        self.words.forget(fresh)
        return [b"".join(ids[a:b]) for a, b in zip([0, *stops.tolist()], stops.tolist())]

    def _library(self, pieces: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


_INDEX = "doc_id long, file string, file_start long, n_tokens long"


def write_sequences(
    docs: DataFrame, store: Store, vocabulary: str, folder: str | None = None, length: int = LENGTH, rows: int = ROWS
) -> DataFrame:
    """Encodes every text, writes the files in ascending doc_id order, and returns the index of documents:
    doc_id, file, file_start (its place in the file), n_tokens (with the end id), start (ids of all documents before it).

    A null text is empty and still gets its end id; a null doc_id comes last; rows that share a doc_id stand
    side by side. Other columns are not read. A task writes a file under a name of its own and the index names only
    files of tasks that finished, so a repeated task leaves at most an unused file behind.
    """
    from tokenizers import Tokenizer

    folder = folder or store.fresh_path("sequences")
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    wide = Tokenizer.from_file(vocabulary).get_vocab_size() > 65536

    def write(batches):
        name = f"{folder}/{uuid.uuid4().hex}.arrow"
        encoder, position, writer, sink = None, 0, None, None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if encoder is None:
                encoder = per_process(("encoder", vocabulary), lambda: PieceEncoder(vocabulary))
                there, path = file_system(name)
                there.create_dir(path.rpartition("/")[0], recursive=True)
                sink = there.open_output_stream(path)
                writer = SequenceWriter(sink, length, rows, wide)
            at = 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and (stop == at or size < PENDING_BYTES):
                    size += len(texts[stop] or "")
                    stop += 1
                found = [[], [], [], []]
                for doc_id, tokens in zip(ids[at:stop], encoder.encode(texts[at:stop])):
                    tokens = np.append(tokens, tokens.dtype.type(END_ID))
                    writer.add(tokens)
                    for column, value in zip(found, (doc_id, name, position, len(tokens))):
                        column.append(value)
                    position += len(tokens)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(found, types)], ["doc_id", "file", "file_start", "n_tokens"]
                )
                at = stop
        if writer is not None:
            writer.close()
            sink.close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    )
    index = store.save(ordered.mapInArrow(write, _INDEX), "sequence-index")
    files = index.groupBy("file").agg(
        F.sum("n_tokens").alias("n"), F.count("doc_id").alias("named"),
        F.min(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))).alias("order"),
    )
    # one row per file, and so one per partition of the write: the only thing the broadcast grows with
    before = Window.orderBy("order", F.col("named").desc(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return index.join(F.broadcast(files), F.col("file") == F.col("_file")).select(
        "doc_id", "file", "file_start", "n_tokens", (F.col("_before") + F.col("file_start")).alias("start")
    )


def read_back(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, and the CRC-32 of its ids as little-endian 32-bit integers."""

    def read(batches):
        path = reader = None
        for batch in batches:
            checks = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "file_start", "n_tokens")))
            for file, start, n in rows:
                if file != path:
                    path, reader = file, SequenceReader(file)
                check = 0
                for view in reader.ids(start, n):
                    check = zlib.crc32(view.astype("<u4"), check)
                checks.append(check)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(checks, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return index.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
