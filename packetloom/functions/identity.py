"""Stable ids: short hex digests of colon-joined keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH = 16


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def flow_id(*parts: Column | str) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *map(_col, parts))), 1, ID_LENGTH)


def stream_flow_id() -> Column:
    """Window id and 5-tuple. The window start is left out: its text form differs between systems."""
    return flow_id("window_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def counterfactual_id(flow: Column | str, neighbour: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", _col(flow), _col(neighbour)), 256), 1, ID_LENGTH)
