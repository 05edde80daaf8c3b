"""Imports every module that registers queries."""

from packetloom.plans import (  # noqa: F401
    queries_flows,
    queries_graph,
    queries_jobs,
    queries_models,
    queries_search,
    queries_similarity,
)
from packetloom.plans.registry import ORACLES, QUERIES  # noqa: F401
