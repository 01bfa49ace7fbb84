"""All queries of the engine by name."""

from __future__ import annotations

from . import catalog, connect, evaluate, ingest, market, scalars, training
from .registry import Query

PARTS = (market, scalars, evaluate, ingest, catalog, connect, training)


def _together(tables: list[dict]) -> dict:
    """One table of all; a name that two of them have is an error."""
    every: dict = {}
    for t in tables:
        if both := every.keys() & t.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        every |= t
    return every


def queries() -> dict[str, Query]:
    return _together([part.registry.queries for part in PARTS])


def oracles() -> dict[str, str]:
    return _together([part.registry.oracles for part in PARTS])
