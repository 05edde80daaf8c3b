"""Runs registered queries next to their SQL twins and compares all values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None:
        return ("0", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        if math.isnan(number):
            return ("n", "nan")
        return ("n", repr(number))
    return ("s", str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str | None:
    relation = con.execute(sql)
    expected_columns = [d[0] for d in relation.description]
    expected = rows_of(expected_columns, relation.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(spark_df.columns) != sorted(expected_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0][0]} != {bad[0][1]}"
    return None


def main(sf_dir: str, only: list[str]) -> None:
    from packetloom.plans import catalog
    from packetloom.session import build_session

    spark = build_session("local[8]")
    con = duck(sf_dir)
    names = [n for n in catalog.QUERIES if not only or any(n.startswith(o) for o in only)]
    failed = []
    for name in names:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            if name in catalog.ORACLES:
                problem = differences(df, con, catalog.ORACLES[name])
                kind = "value"
            else:
                n = df.count()
                problem, kind = (None if n else "no rows"), f"rows={n}"
        except Exception as error:  # noqa: BLE001 - reported per query
            problem, kind = f"{type(error).__name__}: {str(error)[:600]}", "error"
        took = time.time() - start
        print(f"{'FAIL' if problem else 'ok  '} {took:6.2f}s {kind:8s} {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
