"""Registered queries: each operator over the test tables, with an SQL statement for the same result."""

from .core import ORACLES, QUERIES, oracle_statement

__all__ = ["ORACLES", "QUERIES", "load_all", "oracle_statement"]


def load_all() -> None:
    """Import the query modules, which register themselves."""
    from . import (  # noqa: F401
        q_activity,
        q_commits,
        q_compare,
        q_merge,
        q_requests,
        q_sources,
        q_stats,
        q_streaming,
        q_tools,
    )
