"""Severity and volume classes computed at query time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class limits of scores, of volumes in bytes, and of z-scores.
SCORE_LIMITS = [(0.9, "critical"), (0.7, "high"), (0.5, "medium")]
VOLUME_LIMITS = [(100000, "flood"), (10000, "high"), (1000, "moderate")]
Z_LIMITS = [(5.0, "critical"), (3.0, "high"), (1.5, "medium")]
MALICIOUS_DEFAULT = 0.85
NORMAL_DEFAULT = 0.2


def _above(value: Column, limits: list, inclusive: bool = False) -> Column:
    out = None
    for limit, name in limits:
        test = value >= F.lit(limit) if inclusive else value > F.lit(limit)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("low")


def severity_of_score(score: Column) -> Column:
    return _above(score, SCORE_LIMITS)


def severity_of_z(z: Column) -> Column:
    return _above(z, Z_LIMITS, inclusive=True)


def _fallback(normal: float) -> Column:
    return F.coalesce(
        F.col("prediction_score"),
        F.when(F.col("label") == 1, F.lit(MALICIOUS_DEFAULT)).otherwise(F.lit(normal)),
    )


def severity_level() -> Column:
    """A missing score counts as 0 for the level ..."""
    return severity_of_score(_fallback(0.0))


def severity_score() -> Column:
    """... and as 0.2 for the score, so both defaults are kept apart."""
    return _fallback(NORMAL_DEFAULT)


def traffic_volume_category() -> Column:
    return _above(F.coalesce(F.col("total_bytes"), F.lit(0)), VOLUME_LIMITS)


def with_severity(flows: DataFrame) -> DataFrame:
    return flows.withColumns(
        {
            "severity_level": severity_level(),
            "severity_score": severity_score(),
            "traffic_volume_category": traffic_volume_category(),
        }
    )
