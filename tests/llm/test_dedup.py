"""Exact duplicates, SimHash groups and repeated windows, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import exact_dedup, simhash, substring
from packetloom.llm.common import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def ordered(rows):
    return sorted(rows, key=str)


def brute_copies(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(rows[i][0], rows[best[3]][0], len(members), i == best[3], digest) for *_, i in members]
    return ordered(out)


def test_copies(make_docs, store, odd_rows):
    got = exact_dedup.group_copies(make_docs(odd_rows, clash=True), store).drop("_key")
    assert ordered(tuple(r) for r in got.collect()) == brute_copies(odd_rows)


def test_copies_of_an_empty_table(make_docs, store):
    assert exact_dedup.group_copies(make_docs([]), store).count() == 0


def test_drop_copies_keeps_whole_rows_once(make_docs, store, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    kept = exact_dedup.drop_copies(docs, store)
    assert kept.columns == docs.columns
    want = Counter(k for d, k, _, keep, _ in brute_copies(odd_rows) if keep)
    assert Counter(r.doc_id for r in kept.collect()) == want


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return ordered((rows[i][0], f"{fps[i]:016x}", least[find(i)]) for i in range(len(rows)))


def test_simhash_groups(make_docs, store, odd_rows):
    rng = random.Random(3)
    base = [str(rng.randint(0, 500)) for _ in range(400)]
    rows = odd_rows[:4] + odd_rows[5:]
    for i in range(60):  # a chain of small edits, so that groups reach further than 3 bits
        base[rng.randrange(400)] = f"e{i}"
        rows.append((1000 + i, " ".join(base)))
    got = simhash.near_groups(make_docs(rows, clash=True), store).drop("_key")
    want = brute_groups(rows)
    assert ordered(tuple(r) for r in got.collect()) == want
    assert 1 < len({c for d, _, c in want if d and d >= 1000}) < 60


def test_simhash_of_an_empty_table(make_docs, store):
    assert simhash.near_groups(make_docs([]), store).count() == 0


def test_drop_near_copies_keeps_one_of_each(make_docs, store, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    kept = [r.doc_id for r in simhash.drop_near_copies(docs, store).collect()]
    assert ordered(kept) == ordered({c for _, _, c in brute_groups(odd_rows)})


def test_golay_keys_miss_no_pair():
    """All pairs at distance up to 3 meet under the pair of segments that counts for them, exactly once."""
    rng = np.random.default_rng(5)
    for flips in range(1, 4):
        u = rng.integers(-(2**63), 2**63, 3000)
        v = u.copy()
        for row in range(len(v)):
            for bit in rng.choice(64, flips, replace=False):
                v[row] ^= np.int64(-(2**63)) if bit == 63 else np.int64(1) << np.int64(bit)
        filed = defaultdict(list)
        for row, key in zip(*simhash.bucket_keys(u, probe=False)):
            filed[row].append(key)
        looked = defaultdict(set)
        for row, key in zip(*simhash.bucket_keys(v, probe=True)):
            assert key not in looked[row]
            looked[row].add(key)
        for row, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
            differing = [((a ^ b) >> s & ((1 << w) - 1)).bit_count() for s, w in zip(simhash.SHIFTS, simhash.WIDTHS)]
            for kind, (i, j) in enumerate(simhash.PAIRS):
                if differing[i] <= 1 and differing[j] <= 1:
                    assert filed[row][kind] in looked[row]


def test_golay_covers_every_vector():
    patterns, counts = simhash.golay()
    assert sorted(set(counts.tolist())) == [1, 6] and len(patterns) == 2048


def test_components_of_chain_star_and_cycle(spark, store):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), store).collect()}
    want = {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys((200, 201, 202), 200)}
    assert got == want


def brute_removal(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("bucket", [4096, 20])
def test_repeated_windows(make_docs, store, odd_rows, monkeypatch, bucket):
    """With small buckets every shared minimiser is cut into shards."""
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", bucket)
    rng = random.Random(11)
    passage = " ".join(str(rng.randint(0, 99)) for _ in range(50))
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000] + [(20, "x " * 300), (21, "p q " * 200)]
    for i in range(60):
        own = [" ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(0, 60))) for _ in range(2)]
        rows.append((500 + i, f"{own[0]}  {passage}\n{own[1]}"))
    got = substring.remove_repeats(make_docs(rows, clash=True), store)
    assert ordered(tuple(r) for r in got.collect()) == brute_removal(rows)


def test_repeated_windows_of_an_empty_table(make_docs, store):
    assert substring.remove_repeats(make_docs([]), store).count() == 0


def test_keys_looked_up_are_never_broadcast(spark, store):
    """Each of the fingerprints is looked up under many keys, which Spark's estimate does not know."""
    nodes = store.save(spark.range(2_000).select(F.xxhash64("id").alias("fp")), "nodes")
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
