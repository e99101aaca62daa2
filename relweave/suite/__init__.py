"""Queries over the test tables, one or more per operator."""

from relweave.suite import catalog, coherence, constraints, fidelity, generators, integrity, keys, plans, sinks
from relweave.suite.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog", "coherence", "constraints", "fidelity", "generators", "integrity", "keys", "plans", "sinks"]
