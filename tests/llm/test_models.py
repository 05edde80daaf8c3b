"""Language identification, quality, and the pipeline."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import bpe_replay, common, langid, quality, word_quality
from tests.llm.test_dedup import brute_copies, brute_groups

SYLLABLES = {"en": "the of ing ed er on".split(), "fr": "é eau oi le que ment".split(), "de": "sch ung ü der ch ei".split()}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    return [(i, prose(rng, lang, rng.randint(3, 120)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]


def test_languages_held_out(make_docs, store, corpus, odd_rows):
    odd = [(None if d is None else 100_000 + d, t, None) for d, t in odd_rows]
    docs = make_docs(corpus + odd, clash=True)
    out = langid.held_out(F.col("doc_id"))
    filters = langid.fit(docs.where(~out), store)
    found = {r.doc_id: r for r in langid.identify(docs, filters).collect()}
    held = {r.doc_id for r in docs.where(out).select("doc_id").collect()}
    assert filters.languages == ["de", "en", "fr"]
    right = [found[i].lang_pred == lang for i, _, lang in corpus if i in held]
    assert len(right) > 100 and np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    for d in (1, 2, 3, 10):
        assert found[100_000 + d].lang_pred == "und"
    assert {r.doc_id for r in langid.keep_identified(docs, filters).collect()} >= {i for i, _, _ in corpus}
    assert langid.keep_identified(docs, filters).columns == docs.columns


@pytest.mark.parametrize("languages", [["en"], ["en", "fr"]])
def test_identified_with_few_languages(make_docs, store, corpus, languages):
    clean = [r for r in corpus if r[2] in languages]
    # letters no language puts together like this, and a text whose n-grams all languages hold
    odd = [(100_000, "xqzjwkvxqq jzxkqwv qxjzkw vvxqzj", None), (100_001, "12 !!", None), (100_002, "the the of ing", None)]
    twins = [(200_000 + i, "the of ing the of", lang) for i, lang in enumerate(languages * 40)]
    docs = make_docs(clean + odd + twins)
    filters = langid.fit(docs, store)
    assert filters.languages == languages
    kept = {r.doc_id for r in langid.keep_identified(docs, filters).collect()}
    assert kept >= {r[0] for r in clean + twins} | {100_002} and not kept & {100_000, 100_001}


def plain_grams(text):
    letters = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} "
    return [letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1) if letters[i : i + n] != " "]


def test_shares_like_sets_of_grams(make_docs, store, corpus, odd_rows):
    """Against plain sets of n-grams; all n-grams are in the filter, also those that occur once."""
    docs = make_docs(corpus + [(100_000 + i, prose(random.Random(i), "en", 2000), "en") for i in range(8)]
                     + [(None if d is None else 200_000 + d, t) for d, t in odd_rows])
    filters = langid.fit(docs, store)
    counts, of = defaultdict(Counter), Counter()
    for _, text, lang in docs.select("doc_id", "text", "lang").collect():
        for gram in plain_grams(text or ""):
            counts[lang][gram] += 1
            of[lang, len(gram)] += 1
    rare = sum(n < 1e-4 * of["en", len(g)] for g, n in counts["en"].items())
    assert rare > 10

    def share(text, lang):
        grams = plain_grams(text)
        return np.mean([[counts[lang][g] > 0, counts[lang][g] >= max(1, 1e-4 * of[lang, len(g)])] for g in grams])

    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, filters).collect()}
    texts = [(d, t) for d, t, _ in corpus] + [(None, "the xylophone of Zürich, 日本"), (None, "é"), (None, "q w x")]
    for doc_id, text in texts:
        want = np.array([share(text, lang) for lang in filters.languages])
        assert np.abs(filters.shares(text) - want).max() < 0.03
        first, second = np.sort(want)[[-1, -2]]
        if doc_id is not None and first - second > 0.06:
            assert found[doc_id] == filters.languages[int(want.argmax())]


def test_labelled_texts_are_bounded_per_language(make_docs, corpus, monkeypatch):
    docs = make_docs(corpus)
    assert langid.labelled(docs).count() == len(corpus)
    monkeypatch.setattr(langid, "LABELLED_CHARS", 20_000)
    sizes = Counter()
    for lang, text in langid.labelled(docs).collect():
        sizes[lang] += len(text)
    assert set(sizes) == set(SYLLABLES) and all(10_000 < n < 30_000 for n in sizes.values())
    assert sum(len(t) for _, t, lang in corpus if lang == "en") > 30_000


def test_filter_misses_nothing_and_invents_little():
    rng = np.random.default_rng(1)
    filters = langid.LanguageFilter(["a", "b"], np.zeros(1 << 14, np.uint64), np.zeros(2))
    keys, others = (rng.integers(0, 2**63, 1000).astype(np.uint64) for _ in range(2))
    filters.insert(keys, np.full(1000, 2, np.uint64))
    assert (filters.look_up(keys) & np.uint64(2) == 2).all() and (filters.look_up(keys) & np.uint64(1) == 0).all()
    assert np.count_nonzero(filters.look_up(others)) < 30


def test_more_languages_than_bits_of_a_word(make_docs, store):
    # each language has a script of its own, of four letters
    def text(i):
        return " ".join(chr(0x4E00 + 4 * i + k % 4) + chr(0x4E00 + 4 * i + k // 4) for k in range(16))

    docs = make_docs([(i, text(i), f"l{i:03}") for i in range(130)])
    filters = langid.fit(docs, store)
    assert len(filters.languages) == 130
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, filters).collect()} == {i: f"l{i:03}" for i in range(130)}
    assert langid.keep_identified(docs, filters).count() == 130


def test_languages_without_training(make_docs, store):
    docs = make_docs([(1, "some text"), (2, None)])
    filters = langid.fit(docs.where("false"), store)
    assert {r.lang_pred for r in langid.identify(docs, filters).collect()} == {"und"}


def brute_kneser_ney(texts):
    """p(gram) for any 4-gram under the interpolated modified model, from dictionaries."""
    symbols, counts = quality.symbol_sequence(texts)
    tables = {4: Counter(quality.ngrams(symbols, counts).tolist())}
    for order in (3, 2, 1):
        tables[order] = Counter(g & ((1 << 6 * order) - 1) for g in tables[order + 1])
    stats = {}
    for order, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {k: min(max((k - (k + 1) * y * n[k + 1] / n[k]) if n[k] and n[1] else 0.5, quality.LEAST_DISCOUNT), k) for k in (1, 2, 3)}
        total, spare = defaultdict(float), defaultdict(float)
        for g, c in table.items():
            total[g >> 6] += c
            spare[g >> 6] += min(d[min(c, 3)], c)
        stats[order] = d, total, spare

    def p(gram, order=4):
        if order == 0:
            return 1 / 64
        gram &= (1 << 6 * order) - 1
        d, total, spare = stats[order]
        below = p(gram, order - 1)
        if not total.get(gram >> 6):
            return below
        c = tables[order].get(gram, 0)
        own = (c - min(d[min(c, 3)], c)) / total[gram >> 6] if c else 0
        return own + spare[gram >> 6] / total[gram >> 6] * below

    return p


def test_perplexity_like_brute_force(spark, make_docs, store, corpus, odd_rows):
    odd = [(None if d is None else 100_000 + d, t, None) for d, t in odd_rows if len(t or "") < 1000]
    docs = make_docs(corpus + odd, clash=True)
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _, _ in corpus] + [(None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels, store).collect()}
    assert len(got) == len({d for d, *_ in corpus + odd})
    models = {}
    for lang in ("en", "fr", quality.POOLED):
        models[lang] = brute_kneser_ney([t for i, t, x in corpus if i % 2 and lang in (x, quality.POOLED)])
    for doc_id, text, lang in corpus[:40] + odd:
        if lang == "de" or doc_id is None:
            continue
        r = got[doc_id]
        symbols, counts = quality.symbol_sequence([text])
        if not symbols.any():
            assert r.perplexity is None and not r.kept
            continue
        p = models[lang or quality.POOLED]
        logs = [math.log(p(g)) for g in quality.ngrams(symbols, counts).tolist()]
        assert r.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
        assert r.kept == (r.low <= r.perplexity <= r.high)
    trusted = [got[i].kept for i, _, _ in corpus if i % 2]
    assert np.mean(trusted) > 0.97


def brute_words(texts):
    """p(a, b, c) under the interpolated modified model of words, from dictionaries."""
    grams = Counter()
    for text in texts:
        words = ["<", "<", *word_quality.words_of(text or ""), ">"]
        grams.update(zip(words, words[1:], words[2:]))
    tables = {3: grams, 2: Counter(g[1:] for g in grams)}
    tables[1] = Counter(g[1:] for g in tables[2])
    stats = {}
    for order, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {k: min(max((k - (k + 1) * y * n[k + 1] / n[k]) if n[k] and n[1] else 0.5, quality.LEAST_DISCOUNT), k) for k in (1, 2, 3)}
        total, spare = defaultdict(float), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            spare[g[:-1]] += min(d[min(c, 3)], c)
        stats[order] = d, total, spare

    def p(gram):
        if not gram:
            return 1 / (len(tables[1]) + 1)
        d, total, spare = stats[len(gram)]
        below = p(gram[1:])
        if not total.get(gram[:-1]):
            return below
        c = tables[len(gram)].get(gram, 0)
        return (c - min(d[min(c, 3)], c) if c else 0) / total[gram[:-1]] + spare[gram[:-1]] / total[gram[:-1]] * below

    return p


@pytest.mark.parametrize("hot", [word_quality.HOT_ROWS, 5])
def test_word_perplexity_like_brute_force(spark, make_docs, store, corpus, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(word_quality, "HOT_ROWS", hot)
    odd = [(None if d is None else 100_000 + d, t, None) for d, t in odd_rows if len(t or "") < 1000]
    docs = make_docs(corpus + odd, clash=True)
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _, _ in corpus] + [(None, 1)], "doc_id long, quality int")
    rows = word_quality.classify(docs, labels, store).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(corpus + odd)
    models = {}
    for lang in ("en", "fr", quality.POOLED):
        models[lang] = brute_words([t for i, t, x in corpus if i % 2 and lang in (x, quality.POOLED)])
    for doc_id, text, lang in corpus[:60] + odd:
        if lang == "de" or doc_id is None:
            continue
        words, r = word_quality.words_of(text or ""), got[doc_id]
        if not words:
            assert r.perplexity is None and not r.kept
            continue
        words = ["<", "<", *words, ">"]
        logs = [math.log(models[lang or quality.POOLED](g)) for g in zip(words, words[1:], words[2:])]
        assert r.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
        assert r.n_symbols == len(logs) and r.kept == (r.low <= r.perplexity <= r.high)


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "абвгдежзиклмнопр"])
def test_shuffled_words_are_told_from_text(spark, make_docs, store, letters):
    """In any script, words that follow each other in no trusted text are less likely."""
    rng = random.Random(4)
    words = ["".join(rng.choices(letters, k=5)) for _ in range(200)]
    text = [" ".join(words[(start + i) % 200] for i in range(40)) for start in rng.choices(range(200), k=300)]
    mixed = [" ".join(rng.sample(t.split(), 40)) for t in text[:20]]
    docs = make_docs([*enumerate(text), *enumerate(mixed, 1000)])
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in word_quality.classify(docs, labels, store).collect()}
    assert np.mean([kept[i] for i in range(300)]) > 0.95 and not any(kept[1000 + i] for i in range(20))


def test_word_quality_of_empty_tables(spark, make_docs, store):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert word_quality.classify(make_docs([]), none, store).count() == 0
    assert [r.kept for r in word_quality.classify(make_docs([(1, "text"), (2, None)]), none, store).collect()] == [False, False]


def test_quantiles_of_a_class_shrink_towards_the_language(spark):
    def bounds(n):
        rows = [(i, "en", 8, 50.0, 3) for i in range(n)] + [(1000 + i, "en", 1024, 10.0, 10) for i in range(1000)]
        scored = spark.createDataFrame(rows, "doc_id long, lang string, n_symbols long, perplexity double, size int")
        labels = scored.selectExpr("doc_id", "1 quality")
        low = {r.n_symbols: r.low for r in quality.judged(scored, labels, 0.005, 0.995).select("n_symbols", "low").distinct().collect()}
        return low[8], low[1024]

    for n in (20, 199, 200):  # no step at FEW
        assert bounds(n) == (pytest.approx((n * 50 + quality.FEW * 10) / (n + quality.FEW)), pytest.approx(10))


def test_quality_of_empty_tables(spark, make_docs, store):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(make_docs([]), none, store).count() == 0
    assert [r.kept for r in quality.classify(make_docs([(1, "text"), (2, None)]), none, store).collect()] == [False, False]


def test_pipeline(spark, make_docs, corpus, tmp_path):
    """Against brute force of each stage; every filter has something to drop and clean rows stay."""
    rng = random.Random(12)
    item = prose(rng, "en", 30)
    rows = list(corpus)
    rows += [(1000, None, "en"), (1001, "12 34 !!", "en"), (1002, corpus[0][1] + "  ", corpus[0][2]), (1003, f"{corpus[1][1]} {item}", corpus[1][2])]
    long = prose(rng, "en", 900)
    rows += [(1004, long, "en"), (1005, long + " x", "en")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    kept = {d for d, _, _, keep, _ in brute_copies([r[:2] for r in left]) if keep}
    left = [r for r in left if r[0] in kept]
    left_ids = {c for _, _, c in brute_groups([r[:2] for r in left])} - {1003}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == left_ids and got.count() == len(left_ids)
    assert {1000, 1001, 1003, 0} & left_ids == set() and 1002 in left_ids


def test_stages_bound_what_workers_hold(spark, make_docs, tmp_path):
    """Batches are cut by bytes in every stage with Python, and the last stage's blocks are its own; its ids are those of any block size."""
    import public_tokenizers

    docs = make_docs([(i, f"{i} words go on " * 15_000) for i in range(24)]).coalesce(1)  # about 240 kB each
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    for name, stage in corpus_pipeline.STAGES:
        if name == "exact_dedup":  # no Python
            continue
        spark.conf.unset(common.BATCH_SETTING)
        try:
            out = stage(spark, docs, str(tmp_path))
            held = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
            assert sum(held) > common.BATCH_BYTES and max(held) < 1.2 * common.BATCH_BYTES, name
        finally:
            spark.conf.unset(common.BATCH_SETTING)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = bpe_replay.encode_documents(docs, path, public_tokenizers.PATTERN)
    assert sorted(out.collect()) == sorted(whole.collect())


def test_stages_keep_columns(spark, make_docs, corpus, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make_docs(corpus[:50])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_word_quality_scores_each_document_of_an_unstable_scan(spark, make_docs, store):
    """Rows come in another order each time they are computed; every one is scored once, and alike."""
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en") for i in range(400)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    shuffled = docs.repartition(7).orderBy(F.rand())
    got = {r.doc_id: round(r.perplexity, 9) for r in word_quality.classify(shuffled, labels, store).collect()}
    want = {r.doc_id: round(r.perplexity, 9) for r in word_quality.classify(docs, labels, store).collect()}
    assert len(got) == 400 and got == pytest.approx(want, rel=1e-5)


def test_word_quality_leaves_only_its_result_stored(spark, make_docs, store, monkeypatch):
    """Tables go once used, and nothing is counted for the model of all languages where no text asks it."""
    monkeypatch.setattr(word_quality, "with_pooled", lambda counts: pytest.fail("not asked"))
    docs = make_docs([(i, f"some words of text {i % 7}", "en") for i in range(30)])
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    inner = store.scratch("left-over")
    assert word_quality.classify(docs, labels, inner).where("perplexity > 0").count() == 30
    left = [name.rpartition("-")[0] for name in os.listdir(inner.root) if os.listdir(f"{inner.root}/{name}")]
    assert left == ["word-likelihoods"]
    assert spark.conf.get(common.REMOVE_SETTING, None) is None
