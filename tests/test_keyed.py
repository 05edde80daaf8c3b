import pytest

from packetloom.sources.keyed import KeyedTable, ranges

SCHEMA = "k long, value string, version int"


@pytest.fixture()
def table(spark, store):
    table = KeyedTable(spark, store.fresh_path("keyed"), ["k"], ranges("k", 10))
    table.create(spark.createDataFrame([(i, "old", 0) for i in range(50)], SCHEMA))
    return table


def values(table):
    return {r.k: r.value for r in table.read().collect()}


def test_an_update_rewrites_its_parts_only(spark, table):
    before = table.layout()
    touched = table.upsert(spark.createDataFrame([(3, "wrong", 1), (3, "new", 2), (99, "more", 1)], SCHEMA), "version")
    after = table.layout()
    assert touched == {0, 9} and {p for p in before if after[p] != before[p]} == {0}
    assert values(table) == {**{i: "old" for i in range(50)}, 3: "new", 99: "more"}


def test_a_write_without_a_manifest_did_not_happen(spark, table):
    rows = spark.createDataFrame([(3, "half", 1)], SCHEMA)
    rows.write.parquet(f"{table.root}/rows/generation=1/part=0")
    assert set(values(table).values()) == {"old"}
    table.upsert(spark.createDataFrame([(4, "new", 1)], SCHEMA), "version")  # the same generation again
    assert values(table) == {**{i: "old" for i in range(50)}, 4: "new"}


def test_vacuum_keeps_what_is_read(spark, table):
    for turn in range(3):
        table.upsert(spark.createDataFrame([(3, f"turn {turn}", turn + 1)], SCHEMA), "version")
    gone = table.vacuum()
    assert len([g for g in gone if "/rows/" in g]) == 3 and values(table)[3] == "turn 2" and len(values(table)) == 50
    assert table.vacuum() == []


def test_hash_parts_and_empty_updates(spark, store):
    table = KeyedTable(spark, store.fresh_path("keyed"), ["k", "value"])
    assert table.read() is None and table.upsert(spark.createDataFrame([], SCHEMA), "version") == set()
    table.upsert(spark.createDataFrame([(1, "a", 1), (1, "a", 3), (None, "b", 1)], SCHEMA), "version")
    table.upsert(spark.createDataFrame([(1, "a", 2)], SCHEMA), "version")
    assert sorted(((r.k, r.value, r.version) for r in table.read().collect()), key=str) == [(1, "a", 2), (None, "b", 1)]
