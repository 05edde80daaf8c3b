"""Token files and byte-level BPE, against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tokenizers_data
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from packetloom.llm import arrow_tokens, bpe_replay
from packetloom.llm.common import space_pieces

PIECES = [
    "a", "'s", "don't", " ", "  ", "\n", "\t", "\x1c", "1", "23", "é", "ß", "日本語", "<|endoftext|>", "!", "--", "====", "🙂", "\r\n", "ing", "tion", "aaaa",
    " ", " ", "　",
]


@pytest.fixture(scope="module")
def strange_rows(odd_rows):
    rng = random.Random(4)
    rows = [(2000 + i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    return odd_rows + rows + [(5000, "a" * 5000), (5001, " " * 1000), (5002, "=-" * 2000)]


def test_pieces_put_together_are_the_text(strange_rows):
    for _, text in strange_rows:
        first, rest = space_pieces(text or "")
        assert first + "".join(" " + p for p in rest) == (text or "")


@pytest.mark.parametrize("length, rows", [(2048, 64), (16, 4)])
def test_token_files(make_docs, store, strange_rows, length, rows):
    path = tokenizers_data.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = make_docs(strange_rows, clash=True).repartition(5)
    index = arrow_tokens.write_sequences(docs, store, path, length=length, rows=rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in arrow_tokens.read_back(index).collect())
    start, want = 0, []
    for row in got:  # rows that share a doc_id may stand in either order
        want.append((row[0], row[1], start))
        start += row[3]
    assert [r[:3] for r in got] == want

    def digest(text):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert sorted((r[1], *r[3:]) for r in got) == sorted((d or 0, *digest(t)) for d, t in strange_rows)


def test_an_added_token_in_a_text_is_that_token():
    """By the library's defaults, with whatever stands around it."""
    path = tokenizers_data.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), arrow_tokens.PieceEncoder(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>  x", "<|endoftext|", "a<|endoftext|>a <|endoftext|>"]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_reader_takes_any_sequence(tmp_path):
    ids = np.arange(1, 1001, dtype=np.uint16)
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as sink:
        writer = arrow_tokens.SequenceWriter(sink, 16, 4, False)
        writer.add(ids[:700])
        writer.add(ids[700:])
        writer.close()
    reader = arrow_tokens.SequenceReader(str(tmp_path / "x.arrow"))
    assert len(reader) == 64 and reader.batches == 16
    for i in (63, 0, 31, 62):
        values, mask = reader.sequence(i)
        want = ids[16 * i : 16 * (i + 1)]
        assert values.filter(mask).to_pylist() == want.tolist() and len(values) == len(mask) == 16
        assert not values.to_numpy().flags.owndata
    with pa.ipc.open_stream(str(tmp_path / "x.arrow")) as stream:  # any Arrow reader can read the file
        assert sum(b.num_rows for b in stream) == 64


def test_token_files_of_an_empty_table(make_docs, store):
    index = arrow_tokens.write_sequences(make_docs([]), store, tokenizers_data.path("byte_bpe_50k.json"))
    assert arrow_tokens.read_back(index).count() == 0


@pytest.fixture(scope="module")
def replay():
    return bpe_replay.MergeReplay(tokenizers_data.path("byte_bpe_multi_50k.tiktoken"), tokenizers_data.PATTERN)


@pytest.fixture(scope="module")
def library(replay):
    return tiktoken.Encoding("own", pat_str=tokenizers_data.PATTERN, mergeable_ranks=replay.ranks, special_tokens={})


def test_replay_like_the_library(replay, library):
    rng = random.Random(5)
    texts = [
        "".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 127), rng.randint(0x1F300, 0x1FAFF)])) for _ in range(40))
        for _ in range(500)
    ]
    for text, ids in zip(texts, replay.encode(texts)):
        assert ids == library.encode_ordinary(text)


def test_merges_that_open_earlier_ones(tmp_path):
    """Ranks at which the order of merges matters within a word."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"cd", b"abcd", b"ab", b"aa", b"aab", b"ba", b"bab", b"abab"]
    order = tokens[:256] + [b"cd", b"aab", b"abcd", b"bab", b"ab", b"aa", b"ba", b"abab"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order)))
    mine = bpe_replay.MergeReplay(str(path), tokenizers_data.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=tokenizers_data.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text, ids in zip(texts, mine.encode(texts)):
        assert ids == theirs.encode_ordinary(text), text


def test_round_trip(make_docs, library, strange_rows):
    path = tokenizers_data.path("byte_bpe_multi_50k.tiktoken")
    got = bpe_replay.encode_documents(make_docs(strange_rows, clash=True), path, tokenizers_data.PATTERN).collect()
    want = []
    for doc_id, text in strange_rows:
        ids = library.encode_ordinary(text or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode())]
        want.append((doc_id, len(ids), ids, *sha))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_round_trip_of_an_empty_table(make_docs):
    path = tokenizers_data.path("byte_bpe_multi_50k.tiktoken")
    assert bpe_replay.encode_documents(make_docs([]), path, tokenizers_data.PATTERN).count() == 0


def test_a_block_of_ids_is_no_python_objects(spark, monkeypatch):
    """What a task holds for a block: arrays of ids, and the pieces and ids of one text at a time as objects."""
    import tracemalloc

    class Rows:
        select = lambda self, *_: self
        mapInArrow = lambda self, fn, _: fn

    run = bpe_replay.encode_documents(Rows(), tokenizers_data.path("byte_bpe_multi_50k.tiktoken"), tokenizers_data.PATTERN)
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfghkmnprst") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    list(run([batch.slice(0, 3)]))
    tracemalloc.start()
    out = list(run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = sum(sum(b.column("n_tokens").to_pylist()) for b in out)
    assert n > 2_000_000 and peak < 18 * n  # 12 bytes an id; 26 with lists of ids


def test_words_are_encoded_once(monkeypatch):
    """Pieces that differ in signs alone share their words, and each word goes to the model once; the ids are the library's."""
    path = tokenizers_data.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), arrow_tokens.PieceEncoder(path)
    asked = []
    monkeypatch.setattr(encoder, "_library", lambda pieces, whole=encoder._library: (asked.extend(pieces), whole(pieces))[1])
    texts = [" ".join(f"{word}{sign}" for word in ("Haus", "tree", "arbre", "é", "12") for sign in (",", ".", "!", "?", "'s", "\n", "")) + "日本 日本."]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 10


def test_words_are_cut_as_the_library_cuts_them():
    path = tokenizers_data.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), arrow_tokens.PieceEncoder(path)
    around = ["a{}b", "1{}{}2", "a {}{}c", ".{}'s", "x{} {} {}y", "x\n{}\n z"]
    texts = ["q " + form.replace("{}", chr(c)) for c in range(ord(arrow_tokens.LATIN)) for form in around]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
