"""Names of all queries over the engine's own operators."""

from __future__ import annotations

from .queries import ORACLES, QUERIES, Query, flagship

__all__ = ["flagship", "oracles", "queries"]


def queries() -> dict[str, Query]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES
