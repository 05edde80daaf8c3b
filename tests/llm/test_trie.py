"""The trie of conversation prefixes, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from packetloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "h", "base", "block", "prior", "key", "d", "t1", "item", "pos", "depth"):
        df = df.withColumn(name, df["turn"])
    return df


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns[c].append((t is not None, t or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    return ordered(
        (
            min(m),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(m),
            len(children.get(node, ())),
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


def odd_conversations(seed=1):
    """Shared starts, one first turn in a third of all, copies, nulls, ties, repeated rows, very long conversations and texts."""
    rng = random.Random(seed)
    words = ["", "a", "é", "日本", "x y", "a" * 30]
    rows = []
    for c in range(300):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "first" if t == 0 and c % 3 == 0 else rng.choice(words)))
    for c in (400, 401, 402, 500):  # the same long one, with different ends
        rows += [(c, t, "user", words[t * t % 5] + "!" * (c == 402 and t == 160)) for t in range(150 + c % 100 * 9)]
    rows += [(600 + i, t, "user", "same") for i in range(60) for t in range(12)]
    rows += [(700, None, None, None), (700, 5, "user", None), (700, 5, "assistant", "tie"), (700, 5, "assistant", "tie"), (700, -1, "a", "b")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (-105, 0, "user", "below"), (-100, 0, "user", "zero"), (-100, 1, "u", "v")]
    return rows + [(812, 0, "user", "z" * 200_000), (813, 0, "use", "rz"), (814, 0, "user", "z")]


@pytest.mark.parametrize("piece", [8192, 7])
def test_nodes(spark, store, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = odd_conversations()
    got = prefix_trie.prefix_nodes(frame(spark, rows), store)
    assert ordered(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("turns", [7, 8, 9, 16, 64, 65, 72, 513])
def test_lengths_around_the_ends_of_blocks(spark, store, turns):
    rows = [(c, t, "user", str(t // (1 + c % 2 * turns))) for c in (100, 103, 207) for t in range(turns)]
    rows += [(103, turns, "user", "one more")]
    got = prefix_trie.prefix_nodes(frame(spark, rows), store)
    assert ordered(map(tuple, got.collect())) == brute(rows)


def test_only_turnless_conversations(spark, store):
    """Where the first turns go and there is no other conversation to take them from, only the root is left."""
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    got = prefix_trie.prefix_nodes(frame(spark, [(c, 0, "user", "gone")]), store)
    assert [tuple(r) for r in got.collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_an_empty_table(spark, store):
    assert prefix_trie.prefix_nodes(frame(spark, []), store).count() == 0
