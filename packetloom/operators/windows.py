"""Time windows: tumbling, sliding, and sequences and splits of consecutive windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import rank_integers


def time_bounds(packets: DataFrame, ts: str = "timestamp") -> tuple[float, float]:
    """(first, last) time: one row from one aggregate. As plain numbers they keep the plans that use
    them small, where a subquery would be repeated in every expression."""
    row = packets.agg(F.min(ts), F.max(ts)).first()
    return (0.0, 0.0) if row[0] is None else (float(row[0]), float(row[1]))


def tumbling_window(
    packets: DataFrame, delta_t: float, t0: float | None = None, ts: str = "timestamp"
) -> DataFrame:
    """window_id = floor((t - t0) / delta), window_start = t0 + id * delta; t0 = first packet."""
    origin = F.lit(time_bounds(packets, ts)[0] if t0 is None else float(t0))
    width = F.lit(float(delta_t))
    return packets.withColumn("window_id", F.floor((F.col(ts) - origin) / width).cast("long")).withColumn(
        "window_start", origin + F.col("window_id") * width
    )


@dataclass(frozen=True)
class SlidingWindows:
    """Window starts are origin + w * step, w = 0 .. count - 1; a window holds start <= t < start + size."""

    origin: float
    step: float
    count: int
    size: float

    @classmethod
    def over(cls, bounds: tuple[float, float], size: float, stride: float, keep_tail: bool = False) -> "SlidingWindows":
        """All windows that fit between the bounds, at least one; with ``keep_tail`` also those that
        begin before the last packet and end after it."""
        t_min, t_max = bounds
        last_start = t_max if keep_tail else t_max - size
        count = max(1, math.ceil((last_start + 1e-9 - t_min) / stride))
        return cls(t_min, (t_min + stride) - t_min, count, float(size))

    def start(self, w: Column) -> Column:
        return F.lit(self.origin) + w * F.lit(self.step)


def sliding_span(packets: DataFrame, windows: SlidingWindows, ts: str = "timestamp") -> DataFrame:
    """Adds ``first_window`` and ``last_window``: the contiguous range of windows that contain the
    packet. Packets in no window are dropped (gaps, and the tail no whole window fits).

    Each end of the range is found by arithmetic and settled by the exact predicate on the
    neighbouring candidates, so rounding cannot move a packet.
    """
    t, size, start = F.col(ts), F.lit(windows.size), windows.start
    lo = (F.floor((t - windows.origin - size) / windows.step) + 1).cast("long")
    hi = F.floor((t - windows.origin) / windows.step).cast("long")
    guess = packets.withColumns({"_lo": lo, "_hi": hi})
    lo, hi = F.col("_lo"), F.col("_hi")
    lo = F.when(start(lo - 1) + size > t, lo - 1).when(start(lo) + size > t, lo).otherwise(lo + 1)
    hi = F.when(start(hi + 1) <= t, hi + 1).when(start(hi) <= t, hi).otherwise(hi - 1)
    return (
        guess.withColumn("first_window", F.greatest(lo, F.lit(0)))
        .withColumn("last_window", F.least(hi, F.lit(windows.count - 1)))
        .where("first_window <= last_window")
        .drop("_lo", "_hi")
    )


def sliding_windows(
    packets: DataFrame, size: float, stride: float, ts: str = "timestamp", keep_tail: bool = False
) -> DataFrame:
    """One row per (packet, window)."""
    windows = SlidingWindows.over(time_bounds(packets, ts), size, stride, keep_tail)
    return (
        sliding_span(packets, windows, ts)
        .withColumn("window_id", F.explode(F.sequence("first_window", "last_window")))
        .withColumn("window_start", windows.start(F.col("window_id")))
        .drop("first_window", "last_window")
    )


def window_sequences(windows: DataFrame, seq_len: int = 5, stride: int = 1) -> DataFrame:
    """Overlapping runs of ``seq_len`` consecutive windows; the label comes from the last one.

    ``windows`` has one row per window (window_id, num_malicious). Every window joins the at
    most ``seq_len`` runs it belongs to, so no task sees more than one run at a time.
    """
    ranked = rank_integers(windows.select("window_id", "num_malicious"), "window_id", "_i")
    # run starting at s covers positions s .. s + seq_len - 1
    member = ranked.withColumn(
        "_s", F.explode(F.sequence(F.col("_i") - F.lit(seq_len - 1), F.col("_i")))
    ).where((F.col("_s") >= 0) & (F.col("_s") % stride == 0))
    return (
        member.groupBy("_s")
        .agg(
            F.array_sort(F.collect_list("window_id")).alias("window_ids"),
            F.max_by("window_id", "_i").alias("last_window"),
            F.max_by(F.col("num_malicious") > 0, "_i").alias("has_attack"),
        )
        .where(F.size("window_ids") == seq_len)
        .select(
            (F.col("_s") / stride).cast("long").alias("sequence_id"),
            "window_ids",
            "last_window",
            "has_attack",
        )
    )


def _split_bucket(i: Column, n: Column, train: float, val: float, overflow_to_train: bool) -> Column:
    n_train = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
    n_val = F.greatest(F.lit(1), F.floor(n * F.lit(val)))
    tail = F.when(i < n_train, "train").when(i < n_train + n_val, "val").otherwise("test")
    whole = (n_train + n_val > n) if overflow_to_train else (n < 3)
    return F.when(whole, "train").otherwise(tail)


def chronological_split(
    windows: DataFrame, train: float = 0.7, val: float = 0.15, key: str = "window_id"
) -> DataFrame:
    """70/15/15 by time; fewer than three windows are all training."""
    total = windows.agg(F.count("*")).scalar()
    return (
        rank_integers(windows.select(key), key, "_i")
        .withColumn("_n", total)
        .withColumn("split", _split_bucket(F.col("_i"), F.col("_n"), train, val, False))
        .select(key, "split")
    )


def stratified_split(sequences: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Splits attack and normal sequences separately, each in time order."""
    sizes = sequences.agg(
        F.struct(
            F.count_if("has_attack").alias("attack"), F.count_if(~F.col("has_attack")).alias("normal")
        )
    ).scalar()
    n = F.when(F.col("has_attack"), F.col("_sizes.attack")).otherwise(F.col("_sizes.normal"))
    return (
        rank_integers(sequences, "sequence_id", "_i", ["has_attack"])
        .withColumn("_sizes", sizes)
        .withColumn("split", _split_bucket(F.col("_i"), n, train, val, True))
        .drop("_i", "_sizes")
    )


def sequence_position(windows: DataFrame, seq_len: int = 5) -> DataFrame:
    """How many windows, itself included, a window has as context (at most ``seq_len``)."""
    return rank_integers(windows.select("window_id"), "window_id", "_i").select(
        "window_id", F.least(F.col("_i") + 1, F.lit(seq_len)).cast("int").alias("position")
    )
