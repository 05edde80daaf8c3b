import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, lang]); with clash, more columns whose names the operators use inside."""

    def build(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for name in ("_key", "_row", "_i", "_k", "_norm", "fp", "runs", "kept", "hash", "block", "n", "gram", "ids", "start"):
                df = df.withColumn(name, df["n_chars"])
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, many copies."""
    rng = random.Random(7)
    words = ["the", "of", "Anna", "é", "token", "12", "x.", "and\t", "日本"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(20_000))
    same = " ".join(str(i) for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id"), (None, None), (4, "tie tie"), (5, "tie  tie"), (6, "tie tie")]
    rows += [(7, long), (8, long + " end"), (9, "repeated row"), (9, "repeated row"), (10, "!!! ???")]
    return rows + [(100 + i, same) for i in range(40)]
