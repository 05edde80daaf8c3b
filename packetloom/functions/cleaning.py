"""Value cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FLOAT_TYPES = ("double", "float")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null when it is null, NaN or infinite."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if f.dataType.typeName() in _FLOAT_TYPES]
    return df.withColumns({c: finite(c) for c in floats}) if floats else df


def nonfinite_to_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns})


def clean_flow_documents(df: DataFrame, columns: list[str], ts: str = "timestamp") -> DataFrame:
    """Zero for unusable numbers and a default event time."""
    present = [c for c in columns if c in df.columns]
    out = nonfinite_to_zero(df, present)
    if ts in df.columns:
        return out.withColumn("event_time", F.coalesce(F.col(ts).cast("timestamp"), F.current_timestamp()))
    return out.withColumn("event_time", F.current_timestamp())


def sanitise_features(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    clamped = F.least(F.greatest(F.col(label), F.lit(0)), F.lit(1))
    return nonfinite_to_zero(df, features).withColumn(label, clamped)


def epoch_seconds(c: Column | str) -> Column:
    """Microseconds above 1e14, milliseconds above 1e11, else seconds."""
    c = _col(c)
    return F.when(c > 1e14, c / F.lit(1e6)).when(c > 1e11, c / F.lit(1e3)).otherwise(c)


def timestamp_to_seconds(c: Column | str) -> Column:
    return F.unix_micros(_col(c).cast("timestamp")) / F.lit(1e6)


def safe_int(c: Column | str, default: int = 0) -> Column:
    """Numbers lose their fraction; text must be a whole number; anything else is the default."""
    return F.coalesce(_col(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(c: Column | str, default: float = 0.0) -> Column:
    number = _col(c).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(float(default)))
