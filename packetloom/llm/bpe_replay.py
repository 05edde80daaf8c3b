"""Byte-level BPE by replaying the merges over the distinct words of a block of the corpus.

A task takes its documents in blocks of BLOCK_BYTES, cuts them into words, and lays the bytes of all words it
has not met lately end to end. An inverted index leads from a merge to the positions of its token pair. The merges are
applied in rank order, each at all its positions together, and only the neighbours of those positions get
new entries. A word of the corpus is so merged once per block, however often it occurs, and no text is shuffled.
The ids of a block stay in arrays; only those of one text at a time become Python objects.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import PieceCache, distinct_pieces, gathered, on_slices, per_process, space_pieces, strings, words_in

BLOCK_BYTES = 6_000_000
CACHED_WORDS = 400_000  # words whose ids a task remembers; it bounds memory and only saves work
NONE = np.int32(2**31 - 1)


class MergeReplay:
    """Encoder and decoder for the ranks of a vocabulary file: lines of a base64 token and its rank."""

    def __init__(self, path: str, pattern: str, cached_words: int = CACHED_WORDS):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.digits = {rank: b"%d" % rank for rank in self.ranks.values()}
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.words = regex.compile(pattern)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # every way to put a token together from two others; the merged token's rank is the pair's rank
        pairs = sorted(
            (self.ranks[t[:i]] << 32 | self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        )
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int32)
        self.cache = PieceCache(cached_words)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (non-empty) words one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        lengths = np.where(whole >= 0, 1, np.fromiter(map(len, words), np.int64, len(words)))
        # a word that is a token is that token
        laid = b"".join([w if r < 0 else b" " for w, r in zip(words, whole.tolist())])
        symbol = self.byte_rank[np.frombuffer(laid, np.uint8)]
        symbol[(np.cumsum(lengths) - lengths)[whole >= 0]] = whole[whole >= 0]
        n = len(symbol)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(lengths)
        right[ends - 1], left[ends - lengths] = -1, -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)  # of the pair that starts at a position
        inner = np.flatnonzero(right >= 0)
        rank[inner] = self._pair_rank(symbol[inner], symbol[inner + 1])

        inner = inner[rank[inner] != NONE]
        inner = inner[np.argsort(rank[inner], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[inner])) + 1
        index = {int(rank[p[0]]): [p] for p in np.split(inner, cuts) if len(p)}
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            merge = heapq.heappop(queue)
            at = np.unique(np.concatenate(index.pop(merge)))
            at = at[rank[at] == merge]
            if not len(at):
                continue
            # of overlapping places (as in "aaa") every other one, from the left
            chained = np.concatenate(([False], right[at[:-1]] == at[1:]))
            run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            second = right[at]
            after, before = right[second], left[at]
            # a word in which this merge opens an earlier one takes its places one at a time
            opened = np.minimum(
                np.where(after >= 0, self._pair_rank(np.full(len(at), merge), symbol[after]), NONE),
                np.where(before >= 0, self._pair_rank(symbol[before], np.full(len(at), merge)), NONE),
            )
            if (opened < merge).any():
                wary = np.isin(owner[at], owner[at[opened < merge]])
                first = np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))
                later = at[wary & ~first]
                if len(later):
                    index[merge] = [later]
                    heapq.heappush(queue, merge)
                take = ~wary | first
                at, second, after, before = at[take], second[take], after[take], before[take]
            symbol[at] = merge
            alive[second] = False
            rank[second] = NONE
            right[at] = after
            left[after[after >= 0]] = at[after >= 0]
            touched = np.concatenate((at, before[before >= 0]))
            # a neighbour on the left may itself have just been merged away into its own left part
            touched = touched[alive[touched]]
            follower = right[touched]
            fresh = np.where(follower >= 0, self._pair_rank(symbol[touched], symbol[follower]), NONE)
            rank[touched] = fresh
            touched, fresh = touched[fresh != NONE], fresh[fresh != NONE]
            by_rank = np.argsort(fresh, kind="stable")
            touched, fresh = touched[by_rank], fresh[by_rank]
            cuts = np.flatnonzero(np.diff(fresh)) + 1
            bounds = [0, *cuts.tolist(), len(fresh)]
            for r, start, stop in zip(fresh[bounds[:-1]].tolist() if len(fresh) else (), bounds, bounds[1:]):
                if r in index:
                    index[r].append(touched[start:stop])
                else:
                    index[r] = [touched[start:stop]]
                    heapq.heappush(queue, r)
        return symbol[alive], np.add.reduceat(alive.astype(np.int64), ends - lengths)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where those of each begin and end (one more than texts)."""
        spaced, firsts, pieces, per_text = distinct_pieces(space_pieces(t or "") for t in texts)
        words, word_stops = words_in(self.words, spaced, firsts)
        del spaced, firsts
        table = pa.array(words, pa.string()).dictionary_encode()
        words = strings(table.dictionary)
        fresh = self.cache.missing(set(words))
        ids, counts = self.replay(list(map(str.encode, fresh)))
        flat, stops = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
        known = self.cache.young
        known.update(zip(fresh, (flat[a:b] for a, b in zip([0, *stops], stops))))
        del ids, counts, flat, stops
        found = list(map(known.__getitem__, words))
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        flat, ends = gathered(np.frombuffer(b"".join(found), np.int32), stops, table.indices.to_numpy())
        flat, ends = gathered(flat, ends[word_stops], pieces)
        self.cache.forget(fresh)
        return flat, ends[np.concatenate(([0], np.cumsum(per_text)))]

    def encode(self, texts: list[str | None]):
        """Per text: its ids in a list."""
        flat, bounds = self.encode_flat(texts)
        for start, stop in zip(bounds.tolist(), bounds[1:].tolist()):
            yield flat[start:stop].tolist()

    def decimal(self, ids: list[int]) -> bytes:
        return b",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, block_bytes: int = BLOCK_BYTES, cached_words: int = CACHED_WORDS
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids (unless keep_ids is false), ids_sha256, decoded_sha256.

    Each match of `pattern` is encoded by itself, without special tokens. A null text is empty. Other columns are not
    read, rows stay in their partitions. Smaller blocks and fewer remembered words take less memory and more time; the rows are the same.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = per_process(("replay", path, pattern, cached_words), lambda: MergeReplay(path, pattern, cached_words))
        flat, bounds = codec.encode_flat(batch.column("text").to_pylist())
        digests: list[list[str]] = [[], []]
        for start, stop in zip(bounds.tolist(), bounds[1:].tolist()):
            ids = flat[start:stop].tolist()  # of one text at a time: as Python objects they take nine times the room
            digests[0].append(hashlib.sha256(codec.decimal(ids)).hexdigest())
            digests[1].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        arrays = [pa.array(np.diff(bounds), pa.int64()), *(pa.array(d, pa.string()) for d in digests)]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            arrays.insert(1, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)))
            names.insert(1, "ids")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    middle = "ids array<int>, " if keep_ids else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        on_slices("text", run, block_bytes), f"doc_id long, n_tokens long, {middle}ids_sha256 string, decoded_sha256 string"
    )
