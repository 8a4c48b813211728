"""All registered queries of the reference's operators."""

from __future__ import annotations

from tessera.plans import core, ingest, language, more, scoring, shared, stateful, upkeep  # noqa: F401  (they register on import)
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
