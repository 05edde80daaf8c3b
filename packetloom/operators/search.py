"""Filtered, sorted and paged access to the flow tables.

Filters are lists of (column, operator, value). Columns and operators come from fixed lists, so a
caller's filter can never carry code; Catalyst pushes the result down to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.severity import with_severity

Clause = tuple[str, str, object]


def first(ordered: DataFrame, size: int | None) -> DataFrame:
    """The first ``size`` rows; all of them without a size."""
    return ordered if size is None else ordered.limit(size)

OPERATORS = {
    "==": lambda c, v: c == F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def clause_columns(df: DataFrame, clauses: list[Clause]) -> list[Column]:
    out = []
    for column, operator, value in clauses:
        if column not in df.columns:
            raise ValueError(f"Unknown column '{column}'. Known: {sorted(df.columns)}")
        if operator not in OPERATORS:
            raise ValueError(f"Operator '{operator}' not allowed. Allowed: {sorted(OPERATORS)}")
        out.append(OPERATORS[operator](F.col(column), value))
    return out


def where_all(df: DataFrame, clauses: list[Clause] | None) -> DataFrame:
    tests = clause_columns(df, clauses or [])
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def flow_clauses(
    label: int | None = None,
    src_ip: str | None = None,
    dst_ip: str | None = None,
    min_packet_count: float | None = None,
    protocol: int | None = None,
) -> list[Clause]:
    wanted: list[Clause] = [
        ("label", "==", label),
        ("src_ip", "==", src_ip),
        ("dst_ip", "==", dst_ip),
        ("packet_count", ">=", min_packet_count),
        ("protocol", "==", protocol),
    ]
    return [c for c in wanted if c[2] is not None]


def search_flows(
    flows: DataFrame, clauses: list[Clause] | None = None, size: int | None = 20, sort: list | None = None
) -> DataFrame:
    """Top ``size`` matches, or all. The flow id settles the order, so results repeat."""
    return first(where_all(flows, clauses).orderBy(*(sort or []), "flow_id"), size)


def search_anomalous_flows(flows: DataFrame, min_score: float = 0.5, size: int | None = 50) -> DataFrame:
    clauses: list[Clause] = [("prediction", "==", 1), ("prediction_score", ">=", min_score)]
    return search_flows(flows, clauses, size, [F.col("prediction_score").desc()])


def top_flows_per_window(flows: DataFrame, min_score: float = 0.7, size: int = 5) -> DataFrame:
    """The highest scored flows of every window. A limit per group is applied before the shuffle too."""
    best = Window.partitionBy("window_id").orderBy(F.col("prediction_score").desc(), "flow_id")
    hits = where_all(flows, [("prediction", "==", 1), ("prediction_score", ">=", min_score)])
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)


def search_by_severity(
    flows: DataFrame, severity: str | None = None, size: int | None = 20, clauses: list[Clause] | None = None
) -> DataFrame:
    base = with_severity(where_all(flows, clauses))
    if severity:
        base = base.where(F.col("severity_level") == severity)
    return first(base.orderBy(F.col("severity_score").desc(), "flow_id"), size)


def search_packets(packets: DataFrame, clauses: list[Clause] | None = None, size: int | None = 20) -> DataFrame:
    return first(where_all(packets, clauses).orderBy("timestamp", "packet_index"), size)


def page(
    flows: DataFrame,
    size: int = 20,
    after: tuple[float, str] | None = None,
    clauses: list[Clause] | None = None,
    ts: str = "window_start",
) -> DataFrame:
    """Newest first, with the number of all matches on each row; pass the last row's
    (time, flow_id) as ``after`` for the next page. Reads a written, immutable table, so pages fit together."""
    matching = where_all(flows, clauses)
    total = matching.agg(F.count("*")).scalar()
    rest = matching
    if after is not None:
        last_ts, last_id = after
        rest = matching.where(
            (F.col(ts) < F.lit(last_ts)) | ((F.col(ts) == F.lit(last_ts)) & (F.col("flow_id") > F.lit(last_id)))
        )
    return rest.orderBy(F.col(ts).desc(), "flow_id").limit(size).withColumn("total", total)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def explain_match(df: DataFrame, clauses: list[Clause] | None = None) -> DataFrame:
    """Whether each row matches, and which clauses hold. Default: is it malicious."""
    clauses = clauses or [("label", "==", 1)]
    tests = [F.coalesce(c, F.lit(False)) for c in clause_columns(df, clauses)]
    details = [
        F.struct(F.lit(f"{c} {o} {v}").alias("clause"), test.alias("ok"))
        for (c, o, v), test in zip(clauses, tests)
    ]
    return df.withColumn("matched", reduce(lambda a, b: a & b, tests)).withColumn(
        "clauses", F.array(*details)
    )
