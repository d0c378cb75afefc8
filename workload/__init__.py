"""Registered queries: each pairs a library call on the driver tables with the equivalent SQL."""

from workload import evaluation, graphs, layers, pairs, records, text, vectors  # noqa: F401
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
