import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import textindex as ti
from packetloom.operators.textsearch import allowed_edits, search_text

WORDS = ["alpha", "alpah", "beta", "betta", "a", "of", "überall", "uberall", "日本", "x" * 300, "Gamma", "gamma's", "delta2", "deltas"]


def documents(spark, rows):
    """With a column whose name the index uses inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("clash"))


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 3, 3, 40))))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " ,; "), (n + 3, "alpha " * 5000)] + [(n + 10 + i, "same alpha text") for i in range(n // 2)]


def same(index, docs, query, **options):
    got = index.search(query, **options)
    want = search_text(docs, query, "doc_id", "text", **options)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.fixture(scope="module")
def indexed(spark, store):
    old = ti.SEGMENT, ti.FIRST_SEGMENTS
    ti.SEGMENT, ti.FIRST_SEGMENTS = 8, 2
    rows = corpus(120)
    docs = documents(spark, rows)
    index = ti.TextIndex(spark, store.fresh_path("ix"), "doc_id")
    index.add(documents(spark, [(-1, "to be replaced alpha")]), "text", 0)
    index.add(docs.where("doc_id % 2 = 0"), "text", 0)
    index.add(docs.where("doc_id % 2 = 1"), "text", 1)
    yield index, docs
    ti.SEGMENT, ti.FIRST_SEGMENTS = old


@pytest.mark.parametrize("query", ["alpha", "alpa of", "betas gamma ubrall", "日本 a", "x" * 299, "delta", "nothing like it"])
def test_the_index_finds_what_the_search_finds(indexed, query):
    same(*indexed, query, size=7)


@pytest.mark.parametrize("options", [{"size": None}, {"size": 3, "fuzzy": False}, {"size": 10_000}])
def test_options(indexed, options):
    same(*indexed, "alpha betta gama", **options)


def test_a_plan_reads_postings_of_its_terms_only(indexed, capsys):
    index, _ = indexed
    index.search("beta", size=5).explain("formatted")
    plan = capsys.readouterr().out
    assert "In(term" in plan.replace(" ", "") or "EqualTo(term" in plan
    assert "bucket" in plan[plan.index("PartitionFilters") :][:200] and "/postings" in plan and "doc_id" not in plan[: plan.index("ReadSchema")]


def test_segments_out_of_reach_are_not_read(indexed, monkeypatch):
    """What the second round scores is a part of the segments that hold the word."""
    index, _ = indexed
    seen = []
    bounds = index._bounds

    def kept(postings, mean):
        out = bounds(postings, mean)
        seen.append(out)
        return out

    monkeypatch.setattr(index, "_bounds", kept)
    best = index.search("gamma", size=1).collect()
    assert seen[0].where(f"bound >= {best[0].score}").count() < seen[0].count()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_are_all_found(spark, store):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(1500)}
    index = ti.TextIndex(spark, store.fresh_path("ix"), "doc_id")
    index.add(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string"), "text", 0)
    for q in ("ab", "abcab", "abcabc", "aaaaaaaaaa"):
        got = {r.term for r in index.near_words(q).collect()} & words
        assert got == {w for w in words if edits(w, q) <= allowed_edits(q)}


def test_a_query_without_words(indexed):
    assert indexed[0].search(" ?!").collect() == []


def test_an_empty_index(spark, store):
    index = ti.TextIndex(spark, store.fresh_path("ix"), "doc_id")
    index.add(spark.createDataFrame([], "doc_id long, text string"), "text", 0)
    assert index.search("alpha beta").collect() == []


def test_postings_of_a_common_term_are_spread_by_the_number_of_documents(spark, store, monkeypatch):
    from packetloom.operators import textindex

    monkeypatch.setattr(textindex, "SPREAD_DOCUMENTS", 10)
    monkeypatch.setattr(textindex, "SEGMENT", 4)
    docs = spark.createDataFrame([(i, "alpha " + "x " * (i % 5)) for i in range(60)], "doc_id long, text string")
    index = textindex.TextIndex(spark, store.fresh_path("spread"), "doc_id")
    index.add(docs, "text", 0)
    held = index._read("postings").where("term = 'alpha'")
    assert held.selectExpr("input_file_name() AS f").distinct().count() > 1
    assert held.selectExpr("explode(keys) AS k").distinct().count() == 60
