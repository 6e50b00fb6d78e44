"""Registered queries over the benchmark tables."""

from runledger.workload import governance, incidents, runs, streams, text, transactions, workflow  # noqa: F401  (registration)
from runledger.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
