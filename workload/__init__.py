"""The registered queries: each operator on the driver's tables, with an equivalent DuckDB statement."""

from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    """Import the modules that register queries."""
    from workload import (  # noqa: F401
        access,
        conversations,
        detectors,
        policies,
        records,
        rollups,
        streams,
        usage,
        verdicts,
    )
