"""Every registered query of the library with its oracle."""

from __future__ import annotations

from panelforge.plans import aggregates, cases, catalogue, checks, derivations, events, files, grids, intake, layers, metrics, models, panels, records, refits, reports, rules, spatial, stores, streams  # noqa: F401  (they register their queries)
from panelforge.plans.registry import ORACLES, QUERIES

FLAGSHIP = "q187_calendar_zscore"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
